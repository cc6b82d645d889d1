"""Encoding of texts (problem 5) and token budgets (problem 4) under a public tokenizer."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.names import dataset_key, lang_key
from mixloom.llm.bpe import encoder, vocabulary_path
from mixloom.llm.emissions import counter


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """One row (id, ids) for each row of ``df``: the token ids of its whole text.

    * A null text and an empty text have an empty list; strings of special tokens are plain text.
    * Repeated rows come out as often as they went in, a null id stays null, other columns are
      dropped, an empty table gives an empty one with the same schema.
    * A single narrow pass: no shuffle, one vocabulary a worker, Arrow in and out.
    """
    path = vocabulary or vocabulary_path()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            flat, offsets = array("i"), [0]
            for text in batch.column("text").to_pylist():
                flat.extend(encode(text))
                offsets.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "ids"])

    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnsRenamed({"id": id_col, "ids": ids_col})


def count_message_tokens(df: DataFrame, keep: dict, messages_col: str = "messages", vocabulary: str | None = None) -> DataFrame:
    """``keep`` (name -> column) plus ``n_messages`` and ``n_tokens`` of each row's message contents.

    Null lists, null messages and null or empty contents count 0. Exact counts, in linear time:
    the vocabulary's trie with failure links and precomputed emissions (see ``emissions``). Narrow,
    no shuffle.
    """
    path = vocabulary or vocabulary_path()
    contents = F.transform(F.col(messages_col), lambda m: m["content"])
    source = df.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(contents, F.array().cast("array<string>")).alias("contents"))
    schema = ", ".join(f"`{n}` {t}" for n, t in source.dtypes if n != "contents") + ", n_messages bigint, n_tokens bigint"

    def run(batches):
        count = counter(path).count
        for batch in batches:
            lists = batch.column("contents")
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum([count(x) for x in lists.flatten().to_pylist()])]).astype(np.int64)
            n = pa.array(np.diff(ends), pa.int64())
            tokens = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
            names = [x for x in batch.schema.names if x != "contents"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), n, tokens], names=[*names, "n_messages", "n_tokens"])

    return source.mapInArrow(run, schema)


def example_tokens(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every example, each counted once: row_id, dataset, lang, n_messages, n_tokens.

    A row delivered several times has the same messages; of its spellings the key is taken, nulls
    giving way to a name. Texts are counted where they are read, so only a few numbers a row are
    shuffled. Rows without ``row_id`` can't be told to be repeats, so each is an example of its own.
    """
    keep = {"row_id": F.col("row_id"), "dataset": dataset_key(F.col("dataset")), "lang": lang_key(F.col("lang"))}
    single = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())
    counted = count_message_tokens(rows.withColumn("_single", single), keep | {"_single": F.col("_single")})
    known = F.when(F.col("lang") != "und", F.col("lang"))
    return counted.groupBy("row_id", "_single").agg(
        F.min("dataset").alias("dataset"),
        F.coalesce(F.min(known), F.lit("und")).alias("lang"),
        F.max("n_messages").alias("n_messages"),
        F.max("n_tokens").alias("n_tokens"),
    ).drop("_single")


def token_budget(rows: DataFrame, info: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Totals by dataset x language x domain, by each alone, and overall.

    ``level`` names the grouping; columns that aren't grouped by are null. A missing dataset is
    ``(none)``, a dataset without domain has the domain ``(none)``. An empty table gives
    no row.
    """
    cells = example_tokens(rows, vocabulary).groupBy("dataset", "lang").agg(
        F.count(F.lit(1)).alias("n_examples"), F.sum("n_messages").alias("n_messages"), F.sum("n_tokens").alias("n_tokens")
    )
    domains = info.select(dataset_key(F.col("dataset")).alias("dataset"), F.col("domain")).groupBy("dataset").agg(F.min("domain").alias("domain"))
    joined = cells.join(domains, "dataset", "left").na.fill("(none)", ["dataset", "domain"])
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in ("n_examples", "n_messages", "n_tokens")]
    sets = [["dataset", "lang", "domain"], ["dataset"], ["lang"], ["domain"], []]
    level = (
        F.when(F.grouping_id() == 0, "dataset_lang_domain")
        .when(F.grouping_id() == 3, "dataset")
        .when(F.grouping_id() == 5, "lang")
        .when(F.grouping_id() == 6, "domain")
        .otherwise("all")
    )
    return joined.groupingSets([[F.col(c) for c in s] for s in sets], "dataset", "lang", "domain").agg(level.alias("level"), *sums)
