"""Formats of other sources turned into ``messages`` (array of role and content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions.text import strip

MESSAGE = "array<struct<role:string,content:string>>"
#: The instruction prompt with and without further input.
ALPACA = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{i}\n\n### Input:\n{x}\n\n### Response:\n"
ALPACA_PLAIN = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{i}\n\n### Response:\n"
#: Names of roles in other formats.
ROLES = {"human": "user", "Human": "user", "user": "user", "User": "user", "gpt": "assistant", "Assistant": "assistant", "assistant": "assistant", "bard": "assistant", "bing": "assistant", "chatgpt": "assistant", "system": "system"}


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def conversation(*messages: Column) -> Column:
    return F.array(*messages)


def from_fields(**roles: Column) -> Column:
    """One message a field in the order given, e.g. ``from_fields(user=col('q'), assistant=col('a'))``."""
    return F.array(*[message(role, col) for role, col in roles.items()])


def from_instruction(instruction: Column, extra: Column, output: Column) -> Column:
    head, tail = ALPACA_PLAIN.split("{i}")
    h, rest = ALPACA.split("{i}")
    mid, t = rest.split("{x}")
    full = F.concat(F.lit(h), instruction, F.lit(mid), extra, F.lit(t))
    plain = F.concat(F.lit(head), instruction, F.lit(tail))
    return from_fields(user=F.when(F.coalesce(extra, F.lit("")) != "", full).otherwise(plain), assistant=output)


def mapped_role(role: Column, roles: dict[str, str] = ROLES) -> Column:
    table = F.create_map(*[F.lit(x) for p in roles.items() for x in p])
    return F.coalesce(table[role], F.raise_error(F.concat(F.lit("unknown role: "), role)).cast("string"))


def from_conversations(turns: Column, role: str = "from", value: str = "value") -> Column:
    return F.transform(turns, lambda m: message(mapped_role(m[role]), m[value]))


def positional(turns: Column) -> Column:
    """Even places are the user's, odd ones the assistant's; a user's last turn is cut."""
    even = F.slice(turns, 1, F.size(turns) - F.size(turns) % 2)
    return F.transform(even, lambda x, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), x))


def optional_system(system: Column, rest: Column) -> Column:
    return F.concat(F.when(strip(F.coalesce(system, F.lit(""))) != "", F.array(message("system", system))).otherwise(F.array().cast(MESSAGE)), rest)


def is_chat(messages: Column) -> Column:
    return F.coalesce(F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def fold_turns(df: DataFrame, by: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(by).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def alternates(messages: Column, first: str = "user", second: str = "assistant") -> Column:
    return F.coalesce((F.size(messages) > 0) & F.forall(F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, first).otherwise(second)), lambda ok: ok), F.lit(False))


def substitute(messages: Column, values: dict[str, str]) -> Column:
    def content(m):
        out = m["content"]
        for k, v in values.items():
            out = F.replace(out, F.lit(k), F.lit(v))
        return out

    return F.transform(messages, lambda m: message(m["role"], content(m)))


def prepend_system(messages: Column, system: str) -> Column:
    has = F.exists(messages, lambda m: m["role"] == "system")
    return F.when(has, messages).otherwise(F.concat(F.array(message("system", F.lit(system))), messages))


def tag_filter(df: DataFrame, tags: str, unwanted: list[str]) -> DataFrame:
    return df.where(~F.coalesce(F.arrays_overlap(F.transform(F.col(tags), F.lower), F.array(*[F.lit(t.lower()) for t in unwanted])), F.lit(False)))


def to_text(messages: Column) -> Column:
    """``User: ..`` blocks joined by blank lines; other roles capitalised, blank contents left out."""
    kept = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.upper(F.substring(m["role"], 1, 1)), F.lower(F.substr(m["role"], F.lit(2))), F.lit(": "), m["content"])), "\n\n")


def to_users(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.when(m["role"] == "user", "User A: ").otherwise("User B: "), m["content"])), "\n")


def raw_prompt(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def reasoning(thought: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), thought, F.lit("</think><answer>"), answer, F.lit("</answer>"))


def parse_transcript(x: Column) -> Column:
    """``\\n\\nHuman: .. \\n\\nAssistant: ..`` to messages."""
    turns = F.filter(F.split(F.regexp_replace(x, r"\n\n(Human|Assistant): ", "\u0001$1\u0002"), "\u0001"), lambda t: t.contains("\u0002"))
    return F.transform(turns, lambda t: message(F.when(t.startswith("Human"), "user").otherwise("assistant"), F.element_at(F.split(t, "\u0002"), 2)))


def good_pair(chosen: Column, rejected: Column) -> Column:
    filled = lambda a: F.forall(a, lambda m: strip(F.coalesce(m["content"], F.lit(""))) != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))["role"] == "assistant"
    return F.coalesce(filled(chosen) & filled(rejected) & last(chosen) & last(rejected), F.lit(False))


def numbered(quotes: Column) -> Column:
    return F.array_join(F.transform(quotes, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n\n")


def strip_prompt(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, r"^\s*Human:\s*", ""), r"\s*Assistant:\s*\z", ""))


def render(template: str, values: dict[str, Column]) -> Column:
    """``{{ name }}`` replaced by columns."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def tree_paths(df: DataFrame, depth: int = 12, best: int = 2) -> DataFrame:
    """Root-to-leaf paths of a message forest (id, parent_id, role, text, quality, deleted).

    Each node keeps its ``best`` replies by quality (ties: smaller id); deleted nodes end a path. A
    path ends at an assistant's leaf; ``depth`` bounds the rounds of joins.
    """
    from pyspark.sql import Window

    alive = df.where("not coalesce(deleted, false)")
    w = Window.partitionBy("parent_id").orderBy(F.desc_nulls_last("quality"), "id")
    kept = alive.where("parent_id is null").select("id", "parent_id", "role", "text").unionByName(
        alive.where("parent_id is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= best).select("id", "parent_id", "role", "text")
    )
    child = kept.where("parent_id is not null").select(F.col("id").alias("cid"), F.col("parent_id").alias("pid"), F.col("role").alias("crole"), F.col("text").alias("ctext"))
    level = kept.where("parent_id is null").select("id", "role", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    leaves = None
    has_child = child.select(F.col("pid").alias("id")).distinct()
    for _ in range(depth):
        ends = level.join(has_child, "id", "left_anti").where("role = 'assistant'").select("id", "messages")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        level = level.join(child, F.col("id") == F.col("pid")).select(F.col("cid").alias("id"), F.col("crole").alias("role"), F.concat("messages", F.array(F.struct(F.col("crole").alias("role"), F.col("ctext").alias("content")))).alias("messages"))
    return leaves


def split_long(messages: Column, tokens, limit: int) -> Column:
    """Greedy cut of (user, assistant) pairs so that each part has at most ``limit`` tokens, counting
    6 a message; a pair longer than the limit is left out. An array of message arrays."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size(messages) / 2).cast("int"))), lambda i: F.slice(messages, 2 * i - 1, 2))
    pairs = F.filter(pairs, lambda p: F.size(p) == 2)
    size = lambda p: F.aggregate(p, F.lit(0), lambda a, m: a + tokens(m["content"]).cast("int") + 6)
    fitting = F.filter(pairs, lambda p: size(p) <= limit)
    start = F.struct(F.array().cast(f"array<{MESSAGE}>").alias("done"), F.array().cast(MESSAGE).alias("open"), F.lit(0).alias("n"))
    folded = F.aggregate(
        fitting, start,
        lambda s, p: F.when(
            s["n"] + size(p) <= limit, F.struct(s["done"].alias("done"), F.concat(s["open"], p).alias("open"), (s["n"] + size(p)).alias("n"))
        ).otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), p.alias("open"), size(p).alias("n"))),
        lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]),
    )
    return F.when(F.size(messages) < 2, F.array().cast(f"array<{MESSAGE}>")).otherwise(folded)


def gsm_answer(x: Column) -> Column:
    return strip(F.element_at(F.split(x, "####"), -1))


def multiple_choice(correct: Column, wrong: Column) -> Column:
    """Options in case-folded order, and the letter of the correct one."""
    options = F.array_sort(F.concat(F.array(correct), wrong), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))
    return F.struct(options.alias("options"), F.char(64 + F.array_position(options, correct)).alias("letter"))
