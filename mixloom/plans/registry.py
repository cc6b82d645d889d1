"""Named transforms, and the plans that chain them: cached mixture, decontamination, rollouts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.functions import rl
from mixloom.operators import decontam, filters, mixing, tokenize
from mixloom.sources import io

TRANSFORMS: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def register(name: str, kind: str):
    """Adds a ``DataFrame -> DataFrame`` function as a map or filter under a name."""

    def add(fn):
        TRANSFORMS[name] = (fn, kind)
        return fn

    return add


@register("sft_tokenize", "map")
def _sft(df, template="tagged", mask_prompt=False, vocabulary=None, **_):
    return tokenize.chat_tokens(df, "messages", template, "prompt" if mask_prompt else "all", vocabulary=vocabulary)


@register("sft_tokenize_assistant", "map")
def _spans(df, template="tagged", limit=4096, vocabulary=None, **_):
    return tokenize.chat_tokens(df, "messages", template, "assistant", limit, vocabulary)


@register("sft_tokenize_last_turn", "map")
def _last(df, template="tagged", limit=4096, vocabulary=None, **_):
    return tokenize.chat_tokens(df, "messages", template, "last", limit, vocabulary)


@register("preference_tokenize", "map")
def _preference(df, template="tagged", limit=4096, mask="last", vocabulary=None, **_):
    return tokenize.preference_tokens(df, "chosen", "rejected", template, limit, mask, vocabulary)


@register("preference_filter", "filter")
def _pairs(df, max_tokens=None, **_):
    """Both sides have a label and at most ``max_tokens`` ids."""
    keep = F.lit(True)
    for side in ("chosen", "rejected"):
        keep = keep & filters.length_filter(F.col(f"{side}_input_ids"), F.col(f"{side}_input_ids"), F.col(f"{side}_labels"), None, max_tokens)
    return df.where(keep)


@register("verifiable_tokenize", "map")
def _verifiable(df, template="tagged", truth="ground_truth", verifier="dataset", system=None, vocabulary=None, **_):
    """prompt_ids of all but a trailing answer, ground truths and verifiers as lists."""
    parts = tokenize.verifiable(F.col("messages"), F.col(truth), F.col(verifier), template, lambda x: x, system)
    df = df.withColumn("_v", parts).withColumn("_prompt", F.col("_v.prompt_ids")).withColumn("prompt", F.col("_v.prompt"))
    df = df.drop(truth, verifier).withColumn(truth, F.col("_v.ground_truth")).withColumn(verifier, F.col("_v.dataset")).drop("_v", "messages")
    return tokenize.encoded(df, "_prompt", "prompt_ids", vocabulary).drop("_prompt")


@register("verifiable_filter", "filter")
def _prompts(df, max_prompt=None, **_):
    """Prompts of at most ``max_prompt`` ids; without a bound all."""
    return df if max_prompt is None else df.where(F.size("prompt_ids") <= max_prompt)


@register("sft_filter", "filter")
def _keep(df, max_tokens=None, **_):
    return df.where(filters.length_filter(F.col("input_ids"), F.col("input_ids"), F.col("labels"), None, max_tokens))


@register("drop_blank", "filter")
def _blank(df, **_):
    return df.where(~filters.has_blank(F.col("messages")))


@register("drop_provider_identity", "filter")
def _identity(df, **_):
    return df.where(~filters.tells_provider(F.col("messages")))


@register("drop_assistant_names", "filter")
def _names(df, **_):
    return df.where(~filters.names_assistant(F.col("messages")))


def run_transforms(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    for name, arguments in steps:
        df = TRANSFORMS[name][0](df, **arguments)
    return df


@dataclass
class Source:
    name: str
    frame: DataFrame
    key: str
    amount: float | int = 1.0
    steps: list[tuple[str, dict]] = field(default_factory=list)
    revision: str | None = None


def _state(df: DataFrame) -> list:
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(F.to_json(F.struct("*")))), F.sum(F.pmod(F.xxhash64(F.to_json(F.struct("*")), F.lit(1)), F.lit(1 << 31)))).first()
    return [df.schema.simpleString(), *(str(x) for x in row)]


def mixture(sources: list[Source], seed: int = 42) -> DataFrame:
    """Sampled, transformed and concatenated sources with ``dataset_source`` and a dense ``index``."""
    frames = []
    for place, s in enumerate(sources):
        target = mixing.target_size(s.amount, s.frame.count())
        part = mixing.upsample(s.frame, s.key, target, seed).withColumn("dataset_source", F.lit(s.name)).withColumn("_place", F.lit(place))
        frames.append(run_transforms(part, s.steps))
    out = mixing.concat_all(frames)
    return mixing.dense_index(out, [F.col("_place"), F.col("copy_no"), F.col(sources[0].key)]).drop("_place", "copy_no")


def cached_mixture(spark: SparkSession, root: str, sources: list[Source], seed: int = 42) -> DataFrame:
    """The mixture stored under its sources, amounts, steps and the state of the data: each source's
    ``revision``, or else its number of rows, columns and an order-free hash of all its rows."""
    config = {"seed": seed, "sources": [[s.name, s.amount, s.steps, s.revision or _state(s.frame)] for s in sources]}
    out = io.cached(spark, root, config, lambda: mixture(sources, seed))
    if out.isEmpty():
        raise ValueError("the mixture is empty")
    return out


def decontamination(train: DataFrame, key: str, items: DataFrame, item_key: str, item_text: str, threshold: float = 0.5, n: int = 8) -> DataFrame:
    """Training rows none of whose user messages covers a share of an item over the threshold."""
    docs = decontam.user_documents(train, key)
    scores = decontam.ngram_scores(docs, "original_id", "text", items, item_key, item_text, n)
    bad = decontam.contaminated(scores, "original_id", threshold).withColumnRenamed("original_id", key)
    return decontam.decontaminate(train, bad, key)


def rollout_batch(df: DataFrame, prompt: str, reward: str, model_step: str, step: int, max_age: int, mode: str = "standard") -> DataFrame:
    """Fresh results of prompts with spread, with their advantages by prompt."""
    fresh = df.where(filters.not_stale(F.lit(step), F.col(model_step), max_age))
    return rl.advantages(filters.drop_flat_groups(fresh, prompt, reward), prompt, reward, mode)
