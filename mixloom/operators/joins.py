"""Joins that go with the other operators; strategies are left to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_group_size(left: DataFrame, right: DataFrame, key: str, name: str = "num_outputs") -> DataFrame:
    counted = right.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))
    return left.join(counted, key)


def row_group_size(left: DataFrame, right: DataFrame, key: str, name: str = "num_outputs") -> DataFrame:
    """One row a left row that has a match, with the number of its matches. The matches themselves are
    the right rows of the same key: pairs would grow by the square of a hot key."""
    return left.join(right.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key)


def lookup_last(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join with the last of the right rows a key; unmatched left rows are left out."""
    columns = [c for c in right.columns if c != key]
    last = right.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])
    return left.join(last, key)


def replace_answer(df: DataFrame, results: DataFrame, key: str, messages: str, result: str) -> DataFrame:
    """The second message's content replaced by the result of the same key; others are left out."""
    new = F.transform(messages, lambda m, i: F.when(i == 1, F.struct(m["role"].alias("role"), F.col(result).alias("content"))).otherwise(m))
    return df.join(results.select(key, result), key).withColumn(messages, new).drop(result)


def text_key(x: Column) -> Column:
    return F.sha2(x, 256)


def latest_result(df: DataFrame, key: str, value: str, time: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def tool_calls(x: Column, tools: list[str]) -> Column:
    """Spans <name>..</name> of known tools in text order, as {tool, content}."""
    import re

    names = "|".join(re.escape(t) for t in tools)
    spans = F.regexp_extract_all(x, F.lit(rf"(?s)(<({names})>.*?</\2>)"), F.lit(1))
    return F.transform(spans, lambda s: F.struct(F.regexp_extract(s, r"^<([^>]+)>", 1).alias("tool"), F.regexp_extract(s, r"(?s)^<[^>]+>(.*)</[^>]+>\z", 1).alias("content")))


def coerce(x: Column, kind: str) -> Column:
    """A text argument as its JSON-schema type; null where it is none, but a bad boolean raises."""
    if kind == "boolean":
        low = F.lower(F.trim(x))
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).when(x.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), x)).cast("boolean"))
    return {"string": x, "integer": x.try_cast("bigint"), "number": x.try_cast("double"), "array": F.from_json(x, "array<string>"), "object": F.from_json(x, "map<string,string>")}[kind]


def request_rows(df: DataFrame, key: str, prompt: str, model: str) -> DataFrame:
    """One JSON request a row, for a batch service."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def length_prompt(prompt: Column, key: Column, truth: Column, low: int = 100, high: int = 1000) -> Column:
    """A prompt with a hash-chosen length demand, and the ground truth with it."""
    n = F.pmod(F.xxhash64(key), F.lit(high - low + 1)) + low
    return F.struct(F.concat(prompt, F.lit(" Think for "), n.cast("string"), F.lit(" tokens.")).alias("prompt"), F.concat(truth, F.lit("<sep>"), n.cast("string")).alias("ground_truth"))


def few_shot(question: Column, examples: list[tuple[str, str]]) -> Column:
    head = "".join(f"Question: {q}\nAnswer: {a}\n\n" for q, a in examples)
    return F.concat(F.lit(head + "Question: "), question, F.lit("\nAnswer:"))


def environment_samples(spark, n: int) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") % 10 + 1).alias("target"), F.concat(F.lit("Reach the number "), (F.col("id") % 10 + 1).cast("string"), F.lit(".")).alias("prompt"))
