"""Chat templates, tokenisation and label masking.

Templates are column expressions over ``messages``. ``chat_tokens`` encodes a conversation once under
a public byte-level vocabulary and masks labels by where each token begins. The column functions take
any function from a text column to an array of ids; their default splits words and marks and hashes
them, so it needs no files and is prefix-stable at message borders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions.bpe import encoder, vocabulary_path

IGNORE = -100
#: Fixed value: opening of the reasoning templates.
R1 = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. "
    "The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> <answer> answer here </answer>.\n\n"
)
ANSWER_TAGS = ": You must put your answer inside <answer> </answer> tags, i.e., <answer> answer here </answer>. And your final answer will be extracted automatically by the \\boxed{} tag. This is the problem: "
STEPS = "Solve the following problem step by step. The last line of your response should be the answer to the problem in form Answer: $Answer (without quotes) where $Answer is the answer to the problem.\n\n"
CODE_STEPS = "Solve the following code problem step by step. The last part of your response should be the solution to the problem in form ```\npython\nCODE\n``` where CODE is the solution for the problem.\n\n"


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def _join(messages: Column, part: Callable, eos: str, generation: str | None, head: str = "", last_eos: bool = False, pieces: bool = False) -> Column:
    n = F.size(messages)
    parts = F.transform(messages, lambda m, i: part(m["role"], F.coalesce(m["content"], F.lit("")), i == 0, i == n - 1))
    if pieces:
        return F.concat(F.array(F.lit(head)), parts, F.array(F.lit(generation if generation is not None else eos if last_eos else "")))
    body = F.array_join(parts, "")
    tail = F.lit(generation) if generation is not None else F.lit(eos if last_eos else "")
    return F.concat(F.lit(head), body, F.when(n > 0, tail).otherwise(""))


def template(name: str, messages: Column, eos: str = "</s>", generation: bool = False, system: str = "", pieces: bool = False) -> Column:
    """The messages as one text; ``generation`` opens an assistant's turn. Unknown names raise.

    With ``pieces`` the parts of the text instead: what comes before, one for each message, what comes after.
    """
    join = partial(_join, pieces=pieces)
    gap = lambda first, sep: F.when(first, "").otherwise(sep)
    on = lambda x: x if generation else None
    tagged = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}

    def roles(parts: dict[str, Callable]):
        def part(role, content, first, last):
            out = F.lit("")
            for r, f in parts.items():
                out = F.when(role == r, f(content, last)).otherwise(out)
            return out

        return part

    plain = {r: (lambda t: lambda c, last: F.concat(F.lit(t), c, F.lit("\n")))(tagged[r]) for r in ("system", "user")}
    closed = lambda c, last: F.concat(F.lit(tagged["assistant"]), c, F.lit(eos), F.when(last, "").otherwise("\n"))
    after = lambda c: F.element_at(F.split(c, "</think>"), -1)
    if name in ("concat_space", "concat_line"):
        sep = " " if name == "concat_space" else "\n"
        return join(messages, lambda r, c, first, last: F.concat(gap(first, sep), c), eos, on(""), last_eos=True)
    if name == "simple_chat":
        return join(messages, lambda r, c, first, last: F.concat(gap(first, "\n\n"), _capital(r), F.lit(": "), c), eos, on(""), last_eos=True)
    if name == "assistant_only":
        return join(messages, lambda r, c, first, last: F.when(r == "assistant", c).otherwise(""), eos, on(""))
    if name == "tagged_eos":
        each = {r: (lambda t: lambda c, last: F.concat(F.lit(t), c, F.lit(eos + "\n")))(t) for r, t in tagged.items()}
        return join(messages, roles(each), eos, on(tagged["assistant"]))
    if name == "tagged":
        return join(messages, roles(plain | {"assistant": closed}), eos, on(tagged["assistant"]))
    if name == "tagged_thinker":
        return join(messages, roles(plain | {"assistant": closed}), eos, on(tagged["assistant"] + "<think>"))
    if name == "tagged_thinker_r1":
        return join(messages, roles(plain | {"assistant": lambda c, last: closed(after(c), last)}), eos, on(tagged["assistant"] + "<think>"), R1)
    if name in ("im", "im_thinker", "im_no_think", "im_last_thinking"):
        im = lambda r, c: F.concat(F.lit(f"<|im_start|>{r}\n"), c, F.lit("<|im_end|>\n"))

        def answer(c, last):
            c = F.when(last, c).otherwise(after(c)) if name == "im_last_thinking" else c
            return F.concat(F.lit("<|im_start|>assistant\n"), c, F.when(last, eos).otherwise("<|im_end|>\n"))

        body = join(messages, roles({"system": lambda c, last: im("system", c), "user": lambda c, last: im("user", c), "environment": lambda c, last: im("environment", c), "assistant": answer}), eos, on("<|im_start|>assistant\n" + ("<think>" if name in ("im_thinker", "im_last_thinking") else "")))
        if not system:
            return body
        has = F.exists(messages, lambda m: m["role"] == "system")
        opening = F.when(has, "").otherwise(f"<|im_start|>system\n{system}<|im_end|>\n")
        return F.concat(F.array(opening), body) if pieces else F.concat(opening, body)
    if name == "steps":
        return join(messages, lambda r, c, first, last: F.concat(gap(first, "\n\n"), c, F.lit("\n")), eos, on('\nRemember to put your answer on its own line after "Answer:"'), STEPS)
    if name == "code_steps":
        return join(messages, lambda r, c, first, last: F.concat(gap(first, "\n\n"), c, F.lit("\n")), eos, on("\nRemember to put your solution inside the ```\npython\nCODE\n``` tags"), CODE_STEPS)
    if name in ("r1_chat", "r1_think"):
        return join(messages, lambda r, c, first, last: F.concat(gap(first, "\n\n"), _capital(r), F.lit(": "), c, F.lit("\n")), eos, on("Assistant:" + (" <think>" if name == "r1_think" else "")), R1)
    if name == "r1_boxed":
        return join(messages, lambda r, c, first, last: F.concat(gap(first, "\n\n"), _capital(r), F.lit(ANSWER_TAGS), c, F.lit("\n")), eos, on("Assistant: <think>"), R1)
    if name == "boxed_math":
        ask = "\n\nPlease reason step by step, and put your final answer within \\boxed{}<|im_end|>\n"
        return join(messages, roles({"user": lambda c, last: F.concat(F.lit("<|im_start|>user\n"), c, F.lit(ask)), "assistant": lambda c, last: F.concat(F.lit("<|im_start|>assistant\n"), c, F.lit("<|im_end|>\n"))}), eos, on("<|im_start|>assistant\n"))
    raise ValueError(f"unknown template {name!r}")


TEMPLATES = ("concat_space", "concat_line", "simple_chat", "assistant_only", "tagged_eos", "tagged", "tagged_thinker", "tagged_thinker_r1", "im", "im_thinker", "im_no_think", "im_last_thinking", "steps", "code_steps", "r1_chat", "r1_think", "r1_boxed", "boxed_math")


def hashed_tokens(x: Column, size: int = 32_000) -> Column:
    """Ids of words, single marks and runs of white space, by a hash; a null text has none."""
    pieces = F.regexp_extract_all(x, F.lit(r"(?U)(\w+|[^\w\s]|\s+)"), F.lit(1))
    return F.coalesce(F.transform(pieces, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")), F.array().cast("array<int>"))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"hashed": hashed_tokens}


def _learned(sizes: list[int], roles: list, header: int, starts: list[bool], mode: str) -> list[tuple[int, int]]:
    """Byte ranges of a text whose tokens are learned, from the sizes of its pieces."""
    n = len(roles)
    ends = np.cumsum(sizes).tolist()
    first = len(sizes) - n - 1  # pieces before the first message
    at = lambda i: ends[first + i - 1] if first + i else 0
    body = lambda i: at(i) + (header if i and starts[i] else 0)
    if mode == "all" or not n:
        return [(0, ends[-1])]
    if mode == "prompt":
        # The prompt is all but the last message (or the only one) and the header of the answer.
        return [] if n == 1 else [(at(n - 1) + (header if starts[n - 1] else 0), ends[-1])]
    if mode == "last":
        return [(body(n - 1), ends[-1])]
    spans = [(body(i), at(i + 1)) for i in range(n) if roles[i] == "assistant"]
    return spans[:-1] + [(spans[-1][0], ends[-1])] if spans and roles[-1] == "assistant" else spans


def chat_tokens(df: DataFrame, messages: str = "messages", name: str = "tagged", mask: str = "assistant", limit: int | None = None, vocabulary: str | None = None, out: tuple[str, str] = ("input_ids", "labels"), system: str = "") -> DataFrame:
    """The frame with ``input_ids``, ``attention_mask`` and ``labels`` of its conversations, exactly encoded.

    ``mask``: ``all`` learns every token, ``prompt`` those behind the prompt, ``assistant`` those of
    assistants' messages, ``last`` those of the last message; others are IGNORE. A token belongs to
    the message in which it begins, and the header of an answer is never learned. One linear pass:
    each text is encoded once, however many messages it has. Null and empty lists give empty arrays.
    """
    path = vocabulary or vocabulary_path()
    if mask not in ("all", "prompt", "assistant", "last"):
        raise ValueError(f"unknown mask {mask!r}")
    source = df.withColumn("_pieces", template(name, F.col(messages), system=system, pieces=True)).withColumn("_roles", F.transform(messages, lambda m: m["role"]))
    # What a template opens an answer with is the last piece of an empty conversation.
    opened = template(name, F.array().cast("array<struct<role:string,content:string>>"), generation=True, system=system, pieces=True)
    source = source.withColumn("_header", F.element_at(opened, -1))
    new = (out[0], "attention_mask" if out == ("input_ids", "labels") else f"{out[0]}_mask", out[1])
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", `{c}` array<int>" for c in new)

    def run(batches):
        coder = encoder(path)
        lengths = np.zeros(max(coder.length_of) + 1, np.int64)
        lengths[list(coder.length_of)] = list(coder.length_of.values())
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for pieces, roles, header in zip(*(batch.column(c).to_pylist() for c in ("_pieces", "_roles", "_header"))):
                if not roles:
                    columns[0].append([])
                    columns[1].append([])
                    continue
                ids = np.array(coder.encode("".join(pieces)), np.int32)
                starts = np.cumsum(lengths[ids]) - lengths[ids] if len(ids) else np.empty(0, np.int64)
                sizes = [len(p.encode("utf-8", "surrogatepass")) for p in pieces]
                labels = np.full(len(ids), IGNORE, np.int32)
                opens = [p.startswith(header) if header else False for p in pieces[len(pieces) - len(roles) - 1 : -1]]
                for a, b in _learned(sizes, roles, len(header.encode()), opens, mask):
                    span = slice(*np.searchsorted(starts, (a, b)))
                    labels[span] = ids[span]
                columns[0].append(ids[:limit])
                columns[1].append(labels[:limit])
            ids, labels = (pa.array(c, pa.list_(pa.int32())) for c in columns)
            ones = pa.ListArray.from_arrays(ids.offsets, pa.array(np.ones(len(ids.values), np.int32)))
            kept = [n for n in batch.schema.names if n not in ("_pieces", "_roles", "_header")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), ids, ones, labels], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def text_lengths(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """The frame with the number of tokens of a text column; a null text has 0."""
    path = vocabulary or vocabulary_path()
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{name}` bigint"

    def run(batches):
        count = encoder(path).count
        for batch in batches:
            yield batch.append_column(name, pa.array([count(x) for x in batch.column(text).to_pylist()], pa.int64()))

    return df.mapInArrow(run, schema)


def encoded(df: DataFrame, text: str, name: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The frame with the ids of a text column; a null text has none."""
    path = vocabulary or vocabulary_path()
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{name}` array<int>"

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            yield batch.append_column(name, pa.array([encode(x) for x in batch.column(text).to_pylist()], pa.list_(pa.int32())))

    return df.mapInArrow(run, schema)


def preference_tokens(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected", name: str = "tagged", limit: int | None = 4096, mask: str = "last", vocabulary: str | None = None) -> DataFrame:
    """chosen_ and rejected_ input_ids, attention_mask and labels of pairs of conversations."""
    for side, column in (("chosen", chosen), ("rejected", rejected)):
        df = chat_tokens(df, column, name, mask, limit, vocabulary, (f"{side}_input_ids", f"{side}_labels")).withColumnRenamed(f"{side}_input_ids_mask", f"{side}_attention_mask")
    return df


def all_but_last(messages: Column) -> Column:
    return F.when(F.size(messages) > 1, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)


def sft(messages: Column, name: str = "tagged", tokenizer: Callable = hashed_tokens, mask_prompt: bool = False) -> Column:
    """{input_ids, attention_mask, labels, prompt_ids} of a conversation."""
    prompt = tokenizer(template(name, all_but_last(messages), generation=True))
    ids = tokenizer(template(name, messages))
    labels = masked_prefix(ids, F.size(prompt)) if mask_prompt else ids
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"), prompt.alias("prompt_ids"))


def masked_prefix(ids: Column, n: Column) -> Column:
    # No lambda: what ``n`` stands for would be computed anew for each token.
    k = F.least(n, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE), k), F.slice(ids, k + 1, F.size(ids)))


def masked_spans(messages: Column, name: str = "tagged", tokenizer: Callable = hashed_tokens, limit: int = 4096, last_only: bool = False) -> Column:
    """{input_ids, labels}: labels only of assistant's tokens (or only of the last message's).

    A message's span runs from the tokens of the text before it to those of the text with it, with
    the assistant's header where an assistant follows; the tokenizer has to be prefix-stable.
    """
    n = F.size(messages)
    ids = F.slice(tokenizer(template(name, messages)), 1, limit)
    nexts = lambda i: F.coalesce(F.try_element_at(messages, i + 2)["role"] == "assistant", F.lit(False))
    upto = lambda k, header: F.when(k == 0, F.lit(0)).otherwise(F.size(tokenizer(F.when(header, template(name, F.slice(messages, 1, k), generation=True)).otherwise(template(name, F.slice(messages, 1, k))))))
    learned = lambda m, i: (i == n - 1) if last_only else (m["role"] == "assistant")
    spans = F.filter(
        F.transform(messages, lambda m, i: F.struct(learned(m, i).alias("keep"), upto(i, m["role"] == "assistant").alias("a"), upto(i + 1, nexts(i) & (m["role"] != "assistant")).alias("b"))), lambda s: s["keep"]
    )
    # Span by span, so that the ids are looked at once a message and not once a token.
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(state, s):
        a = F.greatest(state["at"], s["a"])
        size = F.greatest(F.lit(0), s["b"] - a)
        return F.struct(F.concat(state["out"], F.array_repeat(F.lit(IGNORE), a - state["at"]), F.slice(ids, a + 1, size)).alias("out"), (a + size).alias("at"))

    known = F.aggregate(spans, start, step, lambda state: state["out"])
    total = F.size(ids)
    labels = F.slice(F.concat(known, F.array_repeat(F.lit(IGNORE), F.greatest(F.lit(0), total - F.size(known)))), F.lit(1), total)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def preference(chosen: Column, rejected: Column, name: str = "tagged", tokenizer: Callable = hashed_tokens, limit: int = 4096) -> Column:
    c, r = masked_spans(chosen, name, tokenizer, limit, True), masked_spans(rejected, name, tokenizer, limit, True)
    ones = lambda a: F.transform(a, lambda _: F.lit(1))
    return F.struct(
        c["input_ids"].alias("chosen_input_ids"), ones(c["input_ids"]).alias("chosen_attention_mask"), c["labels"].alias("chosen_labels"),
        r["input_ids"].alias("rejected_input_ids"), ones(r["input_ids"]).alias("rejected_attention_mask"), r["labels"].alias("rejected_labels"),
    )


def verifiable(messages: Column, truth: Column, verifier: Column, name: str = "tagged", tokenizer: Callable = hashed_tokens, system: str | None = None) -> Column:
    """{prompt_ids, ground_truth, dataset, prompt}: a trailing assistant's message is left out if there
    are more; strings become lists of one."""
    last = F.try_element_at(messages, F.lit(-1))["role"] == "assistant"
    prompt = F.when((F.size(messages) > 1) & last, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)
    if system is not None:
        prompt = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.filter(prompt, lambda m: m["role"] != "system"))
    raw = F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.struct(tokenizer(template(name, prompt, generation=True)).alias("prompt_ids"), F.array(truth).alias("ground_truth"), F.array(verifier).alias("dataset"), raw.alias("prompt"))


def fits_context(messages: Column, completion: int, limit: int, margin: int = 0, tokenizer: Callable = hashed_tokens) -> Column:
    total = F.aggregate(messages, F.lit(0), lambda a, m: a + F.size(tokenizer(m["content"])) + F.when(m["role"] == "system", 4).otherwise(3))
    return total + completion + margin <= limit


def truncate_messages(messages: Column, limit: int, tokenizer: Callable = hashed_tokens) -> Column:
    """All system messages, then others in order while they fit; the first that doesn't is cut to
    the tokens left (at four characters a token), later ones are dropped."""
    cost = lambda m: F.size(tokenizer(m["content"])) + F.when(m["role"] == "system", 4).otherwise(3)
    system = F.aggregate(messages, F.lit(0), lambda a, m: a + F.when(m["role"] == "system", cost(m)).otherwise(0))
    kind = "array<struct<role:string,content:string>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(s, m):
        room = limit - system - s["used"]
        keep = F.struct(F.concat(s["out"], F.array(m)).alias("out"), F.when(m["role"] == "system", s["used"]).otherwise(s["used"] + cost(m)).alias("used"), s["full"].alias("full"))
        cut = F.struct(m["role"].alias("role"), F.substring(m["content"], F.lit(1), F.greatest(F.lit(0), 4 * (room - 3))).alias("content"))
        return F.when(m["role"] == "system", keep).when(s["full"], s).when(cost(m) <= room, keep).otherwise(F.struct(F.when(room > 3, F.concat(s["out"], F.array(cut))).otherwise(s["out"]).alias("out"), s["used"].alias("used"), F.lit(True).alias("full")))

    return F.aggregate(messages, start, step, lambda s: s["out"])


def truncate_for_template(x: Column, rest: str, completion: int, context: int, margin: int = 100, tokenizer: Callable = hashed_tokens) -> Column:
    budget = context - completion - margin - F.size(tokenizer(F.lit(rest)))
    n = F.size(tokenizer(x))
    share = F.greatest(F.lit(0.0), budget / n)
    return F.when(n <= budget, x).otherwise(F.substring(x, F.lit(1), F.floor(F.length(x) * share).cast("int")))
