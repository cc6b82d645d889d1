"""Row filters and projections over ``messages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: providers' names.
PROVIDERS = ["OpenAI", "Open AI", "Claude", "Gemini", "Qwen", "DeepSeek", "Anthropic", "Meta AI", "Meta's", "ChatGPT", "Cohere", "Mistral AI", "Mistral's", "xAI", "Perplexity"]
_P = "(" + "|".join(PROVIDERS) + ")"
_REST = r"\b[^.!?]{0,100}[.!?]"
#: Patterns of a model telling its provider.
IDENTITY = [
    r"\bI'?m\s+" + _P + r",?\s+an?\s+AI\s+(?:assistant|model)[^.!?]{0,100}(?:made|developed|created|trained)\s+by\s+" + _P + _REST,
    r"\b" + _P + r"\s+is\s+an?\s+AI\s+(?:assistant|model)[^.!?]{0,100}(?:developed|created|made|trained)\s+by\s+" + _P + _REST,
    r"\bas\s+an?\s+(?:language\s+model|AI\s+model|assistant|chatbot|model)[^.!?]{0,100}\b" + _P + _REST,
    r"\bas\s+an\s+AI\s+(?:developed|created|made|trained)\s+by\s+" + _P + _REST,
    r"\bI\s+am\s+(?:a\s+)?(?:language\s+model|AI\s+model|assistant|chatbot|model)[^.!?]{0,100}\b" + _P + _REST,
    r"\bI\s+am\s+called\s+\b" + _P + _REST,
    r"\b(?:I'?m|I\s+am)\s+\b" + _P + _REST,
    *[rf"\b{verb}\s+by\s+[^.!?]{{0,100}}?\b" + _P + _REST for verb in ("trained", "developed", "created", "made")],
    r"\bagainst\s+" + _P + r"(?:'s|'s)?\s+(?:use-case\s+)?(?:policy|policies|guidelines|terms)[^.!?]{0,100}[.!?]",
    r"\b" + _P + r"(?:'s|'s)\s+(?:policy|policies|guidelines|terms|use-case)[^.!?]{0,100}[.!?]",
    *[rf"\b{name}\b[^.!?]{{0,100}}[.!?]" for name in ("DeepSeek", "Qwen", r"Alibaba\s+Qwen", r"Alibaba\s+Cloud")],
]
#: Keywords of other assistants; the point of a version is any character.
KEYWORDS = "openai|open ai|chatgpt|chat gpt|gpt-3|gpt3|gpt 3|gpt-4|gpt4|gpt 4|gpt-3.5|gpt3.5|gpt 3.5|bingchat|bing chat|laion|open assistant|openassistant"
#: Fixed value: mention of a knowledge cutoff.
CUTOFF = (
    r"(?i)((?:as\s+(?:of\s+)?(?:my\s+)?(?:last|latest)\s+(?:update|knowledge)(?:\s+was)?\s+in|knowledge\s+cutoff|last\s+updated?\s+in)\s+"
    r"(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+)?\d{4})"
)


def cjk_ratio(x: Column) -> Column:
    n = F.length(x)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.regexp_replace(x, "[一-鿿]", ""))) / n)


def contents(messages: Column, role: str | None = None) -> Column:
    kept = F.filter(messages, lambda m: m["role"] == role) if role else messages
    return F.transform(kept, lambda m: m["content"])


def last_content(messages: Column, role: str = "assistant") -> Column:
    return F.try_element_at(contents(messages, role), F.lit(-1))


def chinese(messages: Column, threshold: float = 0.05, last_two: bool = False) -> Column:
    """Whether the last assistant message (or the last two messages) is Chinese to the threshold."""
    if last_two:
        tail = F.when(F.size(messages) > 1, F.slice(messages, -2, 2)).otherwise(messages)
        return F.coalesce(F.exists(tail, lambda m: F.coalesce((cjk_ratio(m["content"]) > 0) & (cjk_ratio(m["content"]) >= threshold), F.lit(False))), F.lit(False))
    ratio = cjk_ratio(last_content(messages))
    return F.coalesce((ratio > 0) & (ratio >= threshold), F.lit(False))


def think_format(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?s)^<think>.*?</think>.*\z"), F.lit(False))


def think_answer_format(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z"), F.lit(False))


def edit_last(messages: Column, edit) -> Column:
    n = F.size(messages)
    return F.transform(messages, lambda m, i: F.when((i == n - 1) & (m["role"] == "assistant"), F.struct(m["role"].alias("role"), edit(m["content"]).alias("content"))).otherwise(m))


def add_answer_tags(messages: Column) -> Column:
    def edit(x):
        return F.when(x.contains("</think>") & ~x.contains("<answer>"), F.concat(F.regexp_replace(x, r"(?s)^(.*</think>)(\s*)(.*)\z", "$1$2<answer>$3"), F.lit("</answer>"))).otherwise(x)

    return edit_last(messages, edit)


def remove_answer_tags(messages: Column) -> Column:
    return edit_last(messages, lambda x: F.replace(F.replace(x, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))


def cutoff_mentions(messages: Column) -> Column:
    return F.flatten(F.transform(messages, lambda m: F.coalesce(F.regexp_extract_all(m["content"], F.lit(CUTOFF), F.lit(1)), F.array().cast("array<string>"))))


def tells_provider(messages: Column, user_turns: bool = False) -> Column:
    """Whether an assistant's (or also a user's) message is null or tells a provider."""
    pattern = "(?i)(?:" + "|".join(IDENTITY) + ")"
    # Every pattern holds a name: texts without one need no closer look.
    named = "(?i)" + "|".join([*PROVIDERS, "Alibaba"])
    roles = ["assistant", "user"] if user_turns else ["assistant"]
    return F.coalesce(F.exists(messages, lambda m: m["role"].isin(*roles) & (m["content"].isNull() | F.coalesce(m["content"].rlike(named) & m["content"].rlike(pattern), F.lit(False)))), F.lit(False))


def names_assistant(messages: Column) -> Column:
    return F.coalesce(F.exists(messages, lambda m: (m["role"] == "assistant") & F.lower(F.coalesce(m["content"], F.lit(""))).rlike(rf"(?U)\b({KEYWORDS})\b")), F.lit(False))


def has_blank(messages: Column) -> Column:
    return F.coalesce(F.exists(messages, lambda m: ~F.coalesce(m["content"], F.lit("")).rlike(r"(?U)\S")), F.lit(False))


def clean_metadata(toxic: Column, redacted: Column, language: Column, wanted: str) -> Column:
    """A missing flag keeps the row; a missing language is no match."""
    return ~F.coalesce(toxic, F.lit(False)) & ~F.coalesce(redacted, F.lit(False)) & (F.lower(F.coalesce(language, F.lit(""))) == wanted.lower())


def length_filter(prompt: Column, full: Column, labels: Column, max_prompt: int | None, max_full: int | None) -> Column:
    keep = F.exists(labels, lambda x: x != -100)
    if max_prompt is not None:
        keep = keep & (F.size(prompt) <= max_prompt)
    if max_full is not None:
        keep = keep & (F.size(full) <= max_full)
    return keep


def within_band(df: DataFrame, by: str, score: str, low: float, high: float) -> DataFrame:
    """Groups whose mean score lies in the band, with their pass rate."""
    return df.groupBy(by).agg(F.avg(score).alias("pass_rate"), F.count(score).alias("n")).where(F.col("pass_rate").between(low, high))


def drop_flat_groups(df: DataFrame, by: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards differ; max and min are exact where a deviation isn't."""
    mixed = df.groupBy(F.col(by).alias("_by")).agg(F.min(reward).alias("_lo"), F.max(reward).alias("_hi")).where("_hi > _lo").select("_by")
    return df.join(mixed, F.col(by).eqNullSafe(F.col("_by")), "left_semi")


def exclude_solved(df: DataFrame, by: str, reward: str, full: float, rate: float) -> DataFrame:
    """Keys whose share of full rewards reaches the rate."""
    return df.groupBy(by).agg(F.avg((F.col(reward) == full).cast("double")).alias("percent_solved")).where(F.col("percent_solved") >= rate)


def drop_identical(df: DataFrame, by: str, text: str) -> DataFrame:
    """Prompts of which not all completions are the same (a single one always is)."""
    keep = df.groupBy(by).agg(F.min(text).alias("_a"), F.max(text).alias("_b")).where("_a <> _b").select(by)
    return df.join(keep, by, "left_semi")


def not_stale(training_step: Column, model_step: Column, max_age: int) -> Column:
    return F.coalesce(training_step - model_step <= max_age, F.lit(True))


def guard_counts(kept: int, total: int, tolerance: float = 0.01) -> None:
    if total and abs(total - kept) / total > tolerance:
        raise ValueError(f"{kept} of {total} rows are left, more than {tolerance:.0%} differ")


def merge_env(base: Column, override: Column) -> Column:
    return F.map_zip_with(base, override, lambda _, a, b: F.coalesce(b, a))


def resolve_tools(definitions: Column, wanted: Column) -> Column:
    """Definitions (struct with name) the row asks for; null asks for all, an empty list for none."""
    return F.when(wanted.isNull(), definitions).otherwise(F.filter(definitions, lambda d: F.array_contains(wanted, d["name"])))


def unknown_tools(df: DataFrame, tools: str, known: list[str]) -> DataFrame:
    return df.select(F.explode(tools).alias("tool")).distinct().where(~F.col("tool").isin(*known))


def normalize_env(raw: Column) -> Column:
    """JSON of an environment config in any of its shapes to {env_configs, max_steps}."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("env_configs array<map<string,string>>, max_steps int")
    def run(s):
        import json

        import pandas as pd

        def one(x):
            if x is None:
                return (None, None)
            v = json.loads(x)
            if v is None:
                return (None, None)
            flat = lambda d: {k: str(w) for k, w in d.items() if w is not None}
            if isinstance(v, list):
                return ([flat(e) for e in v], None)
            if "env_configs" in v:
                return ([flat(e) for e in v["env_configs"]], v.get("max_steps"))
            if "env_name" in v:
                return ([flat({k: w for k, w in v.items() if k != "max_steps"})], v.get("max_steps"))
            return ([], v.get("max_steps"))

        return pd.DataFrame([one(x) for x in s], columns=["env_configs", "max_steps"])

    return run(raw)
