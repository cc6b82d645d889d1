"""Sequence packing, batching and collation over array columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.session import cut


def pack_greedy(df: DataFrame, shard: str, order: str, length: str, capacity: int, min_batches: int = 1) -> DataFrame:
    """(shard, order, pack_id, place): rows in order fill packs of at most min(total // min_batches,
    capacity); a longer row gets its own pack.

    The fold depends on the order, so it runs shard by shard: rows must be given to shards that fit
    one task (a hash or a range of the order key), and one shard alone is the sequential result.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        limit = max(1, min(int(pdf["n"].sum()) // max(1, min_batches), capacity))
        pack, used, place, out = 0, 0, 0, []
        for n in pdf["n"]:
            if place and used + n > limit:
                pack, used, place = pack + 1, 0, 0
            out.append((pack, place))
            used, place = used + n, place + 1
        return pdf.assign(pack_id=[p for p, _ in out], place=[p for _, p in out])[["s", "o", "n", "pack_id", "place"]]

    source = df.select(F.col(shard).alias("s"), F.col(order).alias("o"), F.col(length).cast("bigint").alias("n"))
    packed = source.groupBy("s").applyInPandas(run, f"s {kinds[shard]}, o {kinds[order]}, n bigint, pack_id bigint, place bigint")
    return packed.withColumnsRenamed({"s": shard, "o": order, "n": length})


def pack_two(df: DataFrame, shard: str, order: str, lengths: tuple[str, str], capacity: int, most: int, world: int) -> DataFrame:
    """Packs bounded by the longer of two streams' sums and by a number of rows; ranks round-robin."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        pack, a, b, n, out = 0, 0, 0, 0, []
        for x, y in zip(pdf["a"], pdf["b"]):
            if n and (a + x > capacity or b + y > capacity or n >= most):
                pack, a, b, n = pack + 1, 0, 0, 0
            out.append(pack)
            a, b, n = a + x, b + y, n + 1
        return pdf.assign(pack_id=out, rank=[p % world for p in out])[["s", "o", "pack_id", "rank"]]

    source = df.select(F.col(shard).alias("s"), F.col(order).alias("o"), F.col(lengths[0]).cast("bigint").alias("a"), F.col(lengths[1]).cast("bigint").alias("b"))
    return source.groupBy("s").applyInPandas(run, f"s {kinds[shard]}, o {kinds[order]}, pack_id bigint, rank bigint").withColumnsRenamed({"s": shard, "o": order})


def strided_ranks(df: DataFrame, index: str, world: int, total: int, drop_last: bool = True) -> DataFrame:
    """Row ``index`` goes to rank index % world; a remainder is dropped, or filled from the front."""
    even = total - total % world
    out = df.where(F.col(index) < even) if drop_last else df
    out = out.withColumn("rank", (F.col(index) % world).cast("int")).withColumn("batch", F.floor(F.col(index) / world))
    if not drop_last and total % world:
        extra = df.where(F.col(index) < world - total % world).withColumn("rank", ((F.col(index) + total) % world).cast("int")).withColumn("batch", F.floor((F.col(index) + total) / world))
        out = out.unionByName(extra)
    return out


def within_budget(df: DataFrame, by: str, order: str, length: str, budget: int) -> DataFrame:
    """How many rows of each group, in order, fit the token budget."""
    return running_total(df, by, order, length, "_s").groupBy(by).agg(F.count_if(F.col("_s") <= budget).alias("fitting"))


def running_total(df: DataFrame, by: str, order: str, length: str, name: str) -> DataFrame:
    """Sum of a group's lengths up to and with each row, in order.

    A hot group is cut into ranges of the order key: sums run within a range, and each range starts
    at the total of those before it, so no task sees a whole group.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written once: range bounds are sampled, so a second run could cut the ranges elsewhere.
    parts = cut(df.repartitionByRange(n, by, order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(by, "_p").agg(F.sum(length).alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(w), F.lit(0))).select(F.col(by).alias("_by"), F.col("_p").alias("_q"), "_before")
    inside = parts.withColumn("_in", F.sum(length).over(Window.partitionBy(by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q"))).withColumn(name, F.col("_before") + F.col("_in")).drop("_by", "_q", "_before", "_in", "_p")


def boundaries(lengths: Column) -> Column:
    """Cumulative lengths from 0."""
    start = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(lengths, start, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def position_ids(lengths: Column) -> Column:
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))))


def sequence_ids(lengths: Column) -> Column:
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n.cast("int"))))


def flat_labels(labels: Column) -> Column:
    """Labels of several rows in one list, the first of each masked."""
    return F.flatten(F.transform(labels, lambda a: F.transform(a, lambda y, j: F.when(j == 0, -100).otherwise(y))))


def collate(df: DataFrame, by: str, order: str, ids: str, labels: str) -> DataFrame:
    """One padding-free row a pack: input_ids, labels, position_ids, seq_idx, cu_seq_lens."""
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, ids, labels))).alias("r"))
    lengths = F.transform("r", lambda x: F.size(x[ids]))
    return rows.select(
        by, F.flatten(F.transform("r", lambda x: x[ids])).alias("input_ids"), flat_labels(F.transform("r", lambda x: x[labels])).alias("labels"),
        position_ids(lengths).alias("position_ids"), sequence_ids(lengths).alias("seq_idx"), boundaries(lengths).alias("cu_seq_lens"),
    )


def pad_right(x: Column, n: Column, value: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.lit(0), n.cast("int") - F.size(x))))


def pad_batch(df: DataFrame, batch: str, columns: dict[str, int]) -> DataFrame:
    """Array columns padded with their value to the longest of all of them in the batch."""
    most = F.max(F.greatest(*[F.size(c) for c in columns], F.lit(0))).over(Window.partitionBy(batch))
    return df.withColumn("_n", most).withColumns({c: pad_right(F.col(c), F.col("_n"), v) for c, v in columns.items()}).drop("_n")


def scatter(lookup: Column, mask: Column) -> Column:
    """Value of each token's document, by 1-based document ids; 0 elsewhere."""
    return F.transform(mask, lambda i: F.when(i > 0, F.element_at(lookup, i)).otherwise(F.lit(0.0)))


def worker_blocks(df: DataFrame, index: str, total: int, workers: int) -> DataFrame:
    """Contiguous blocks of total // workers rows; the remainder is dropped."""
    size = total // workers
    return df.where(F.col(index) < size * workers).withColumn("worker", F.floor(F.col(index) / max(1, size)).cast("int"))


def token_offsets(df: DataFrame, shard: str, order: str, length: str) -> DataFrame:
    """Start and end of each row's tokens within its shard's file."""
    return running_total(df, shard, order, length, "end").withColumn("start", F.col("end") - F.col(length))
