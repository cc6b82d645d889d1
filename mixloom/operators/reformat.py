"""Row formats of published instruction sources turned into messages, and result rows joined back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.functions.text import strip
from mixloom.operators.messages import MESSAGE, message
from mixloom.operators.mixing import seeded


def chosen_messages(df: DataFrame) -> DataFrame:
    """``messages`` from ``chosen`` where a frame has chosen, rejected and reference_completion."""
    return df.withColumn("messages", F.col("chosen")) if {"chosen", "rejected", "reference_completion"} <= set(df.columns) else df


def model_matches(df: DataFrame, model: str, pattern: str) -> DataFrame:
    """Rows whose model's name holds the pattern; a null name doesn't."""
    return df.where(F.coalesce(F.col(model).rlike(pattern), F.lit(False)))


def with_answers(trajectory: Column, chosen: Column, rejected: Column) -> Column:
    """{chosen, rejected}: the trajectory with either answer as its last message."""
    return F.struct(F.concat(trajectory, F.array(message("assistant", chosen))).alias("chosen"), F.concat(trajectory, F.array(message("assistant", rejected))).alias("rejected"))


def picked(key: Column, options: list[str], seed: int = 42) -> Column:
    """One of the options, by a hash of the key."""
    at = F.pmod(F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(len(options)))
    return F.element_at(F.array(*[F.lit(o) for o in options]), (at + 1).cast("int"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` in a template column replaced by columns, nulls by nothing."""
    return reduce(lambda t, kv: F.replace(t, F.lit(f"{{{kv[0]}}}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)


def reformat(df: DataFrame, key: str, kind: str, templates: list[str] | None = None, shots: int = 0) -> DataFrame:
    """(key, messages) of one of the kinds of source rows; unknown kinds raise.

    * ``instruction``: instruction, input, output; ``question``: question, answer; ``pair``: prompt,
      completion; ``turns``: an array of alternating texts; ``conversations``: from / value.
    * ``templates`` with {instruction}, {input}, .. are chosen by a hash of the key; ``shots``
      examples of the same frame, chosen by hash, go before the question.
    * Rows whose question or answer is null or blank give none.
    """
    fields = {"instruction": ("instruction", "output"), "question": ("question", "answer"), "pair": ("prompt", "completion")}
    if kind == "turns":
        return df.select(key, F.transform("turns", lambda x, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), x)).alias("messages")).where(F.size("messages") > 1)
    if kind == "conversations":
        role = lambda m: F.when(m["from"].isin("human", "user"), "user").when(m["from"] == "system", "system").otherwise("assistant")
        return df.select(key, F.transform("conversations", lambda m: message(role(m), m["value"])).alias("messages")).where(F.size("messages") > 0)
    if kind not in fields:
        raise ValueError(f"unknown kind of source {kind!r}")
    ask, reply = fields[kind]
    good = (strip(F.coalesce(ask, F.lit(""))) != "") & (strip(F.coalesce(reply, F.lit(""))) != "")
    question = F.col(ask)
    if "input" in df.columns and kind == "instruction":
        question = F.when(F.coalesce("input", F.lit("")) != "", F.concat(question, F.lit("\n\n"), F.col("input"))).otherwise(question)
    if templates:
        question = filled(picked(F.col(key), templates), {c: F.col(c) for c in df.columns if c != key})
    if shots:
        some = df.where(good).orderBy(seeded(F.col(key)), key).limit(shots).select(ask, reply).collect()
        question = F.concat(F.lit("".join(f"Q: {r[0]}\nA: {r[1]}\n\n" for r in some) + "Q: "), question, F.lit("\nA:"))
    return df.where(good).select(key, F.array(message("user", question), message("assistant", F.col(reply))).alias("messages"))


def thinker(df: DataFrame, key: str, text: str, tokens: dict[str, str]) -> DataFrame:
    """Reserved tokens written as tags, an open answer closed, and the ground truth behind the reasoning."""
    x = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), tokens.items(), F.col(text))
    closed = F.when(x.contains("<answer>") & ~x.contains("</answer>"), F.concat(x, F.lit("</answer>"))).otherwise(x)
    return df.select(key, closed.alias(text), strip(F.element_at(F.split(x, "</think>"), -1)).alias("ground_truth"))


def to_sft(df: DataFrame, key: str, required: list[str], question: str, answer: str, good: str | None = None) -> DataFrame:
    """Messages of verifiable rows that have all required fields (and pass the ``good`` flag)."""
    keep = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    if good:
        keep = keep & F.coalesce(F.col(good), F.lit(False))
    return df.where(keep).select(key, F.array(message("user", F.col(question)), message("assistant", F.col(answer))).cast(MESSAGE).alias("messages"))


def skipped(df: DataFrame, required: list[str], good: str | None = None) -> DataFrame:
    """One row: rows, those lacking a field, and those with all fields that aren't good."""
    lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    bad = ~lacking & ~F.coalesce(F.col(good), F.lit(False)) if good else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(lacking).alias("lacking"), F.count_if(bad).alias("not_good"))


def solved_by(df: DataFrame, solution: str, generator: str, name: str, none: str = "NO SOLUTION") -> DataFrame:
    """Rows of one generator that have a solution."""
    return df.where((F.col(solution) != none) & (F.col(generator) == name))


def joined_results(df: DataFrame, results: DataFrame, key: str, response: str, schema: str) -> DataFrame:
    """Source rows with the fields of their JSON response; rows without one that can be read are left out."""
    parsed = results.select(key, F.from_json(F.col(response), schema).alias("_r")).where("_r is not null")
    return df.join(parsed, key).select(df["*"], "_r.*")


def persona_prompts(personas: DataFrame, key: str, persona: str, template: str, constraints: list[str], most: int = 3) -> DataFrame:
    """(key, prompt, constraints): one to ``most`` constraints a persona, chosen by hash."""
    n = F.pmod(F.xxhash64(key), F.lit(most)) + 1
    ranked = F.array_sort(F.array(*[F.struct(seeded(F.concat(F.col(key).cast("string"), F.lit(c))).alias("h"), F.lit(c).alias("c")) for c in constraints]))
    chosen = F.transform(F.slice(ranked, F.lit(1), n.cast("int")), lambda s: s["c"])
    return personas.select(key, filled(F.lit(template), {"persona": F.col(persona), "constraints": F.array_join(chosen, ", ")}).alias("prompt"), chosen.alias("constraints"))
