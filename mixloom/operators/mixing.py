"""Mixing, sampling and set operations over DataFrames.

Random choices are orders by a hash of a row id and a seed, so they don't depend on partitions.
``seeded`` uses md5, which other engines compute alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.session import cut

#: Parts a hot group is dealt out to before its rows meet.
SALTS = 64


def seeded(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def parse_mixer(parts: list) -> dict[str, float | int]:
    """``[name, amount, ..]`` to a dict; an amount with a point is a fraction, else a count."""
    if len(parts) % 2:
        raise ValueError("names and amounts must alternate")
    out: dict[str, float | int] = {}
    for name, amount in zip(parts[::2], parts[1::2]):
        if not isinstance(name, str):
            raise ValueError("a dataset's name must be a string")
        out[name] = (float(amount) if "." in str(amount) else int(amount)) if isinstance(amount, str) else amount
    return out


def target_size(amount: float | int, n: int) -> int:
    """Rows of a transform mix: a float is a share of n, an int a count (1 is one row, 1.0 all)."""
    if amount < 0:
        raise ValueError("Dataset fractions / lengths cannot be negative.")
    return int(amount * n) if isinstance(amount, float) else int(amount)


def combined_size(amount: float | int, n: int) -> int:
    """Rows of a combined mix: an amount above 1 is a count, else a share (1 is all rows)."""
    if amount < 0:
        raise ValueError("Dataset fractions / lengths cannot be negative.")
    return min(n, int(amount)) if amount > 1.0 else int(amount * n)


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Row numbers from 1 within groups; a global order only after range partitioning."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return dense_index(df, order, name, 1)


def dense_index(df: DataFrame, order: list[Column], name: str = "index", first: int = 0) -> DataFrame:
    """Dense numbers over a total order without one task seeing all rows: rows are sorted into
    range partitions, and each partition starts after the counts of those before it."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written once, sorted: range bounds are sampled, so a second run could cut the partitions elsewhere.
    # Each task writes one file after the other, so a row's partition and place in it are its number.
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = cut(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_off", F.lit(0)).alias("_off"))
    # One row a partition.
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_off") + F.col("_k") + first).drop("_p", "_k", "_off")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by hash order; a top-n, no full sort."""
    return df.orderBy(seeded(F.col(key), seed), F.col(key)).limit(n)


def upsample(df: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """target // n whole repeats and target % n sampled rows; ``copy_no`` tells them apart."""
    n = df.count()
    if not n or not target:
        return df.limit(0).withColumn("copy_no", F.lit(0))
    whole, rest = divmod(target, n)
    out = df.limit(0).withColumn("copy_no", F.lit(0))
    if whole:
        out = repeat_rows(df, whole, "copy_no")
    if rest:
        out = out.unionByName(sample_n(df, key, rest, seed).withColumn("copy_no", F.lit(whole)))
    return out


def repeat_rows(df: DataFrame, k: int, name: str = "copy_no") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k > 0 else df.limit(0).withColumn(name, F.lit(0))


def concat_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine(sources: dict[str, tuple[DataFrame, str, float | int]], split: str = "train", seed: int = 42) -> DataFrame:
    """Hash-ordered prefixes of several sources with an ``id`` of source, place and split."""
    frames = []
    for name, (df, key, amount) in sources.items():
        n = combined_size(amount, df.count())
        frames.append(dense_index(sample_n(df, key, n, seed), [seeded(F.col(key), seed), F.col(key)], "_i").withColumn("id", F.concat(F.lit(f"{name}_"), F.col("_i").cast("string"), F.lit(f"_{split}"))).drop("_i"))
    return concat_all(frames)


def legacy_mix(sources: dict[str, tuple[DataFrame, str, float | int]], columns: list[str], seed: int = 42, keep_source: bool = True) -> DataFrame:
    """Fractions of at most 1, or all counts; missing columns become null, sources get an id."""
    amounts = [a for _, _, a in sources.values()]
    if any(a < 0 for a in amounts):
        raise ValueError("Dataset fractions / lengths cannot be negative.")
    if any(a > 1 for a in amounts) and any(isinstance(a, float) for a in amounts):
        raise ValueError("fractions and counts can't be mixed")
    frames = []
    for name, (df, key, amount) in sources.items():
        n = df.count()
        take = int(amount) if amount > 1 else int(amount * n)
        part = dense_index(sample_n(df, key, take, seed), [seeded(F.col(key), seed), F.col(key)], "_i")
        part = part.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], F.concat(F.lit(f"{name}_"), F.col("_i").cast("string")).alias("id"))
        frames.append(part.withColumn("source", F.lit(name)) if keep_source else part)
    return concat_all(frames)


def project(df: DataFrame, columns: list[str], preserve: tuple[str, ...] = ("dataset_source", "tools", "env_config")) -> DataFrame:
    return df.select(*[c for c in df.columns if c in columns or c in preserve])


def drop_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def remove_sources(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of other sources; a null source stays."""
    return df.where(~F.coalesce(F.col(column).isin(*names), F.lit(False)))


def stratified(df: DataFrame, by: str, portions: dict[str, float], total: int, key: str, seed: int = 42) -> DataFrame:
    """int(portion * total) rows of each stratum, by hash order."""
    if not math.isclose(sum(portions.values()), 1.0, abs_tol=1e-9):
        raise ValueError("portions must add up to 1")
    # A top-n for each stratum: every task keeps n rows, so a hot stratum isn't sorted in one task.
    parts = [df.where(F.col(by) == k).orderBy(seeded(F.col(key), seed), F.col(key)).limit(int(p * total)) for k, p in portions.items()]
    return reduce(DataFrame.unionByName, parts)


def offset_slice(df: DataFrame, key: str, offset: int, size: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(F.col(key), seed), F.col(key)).offset(offset).limit(size)


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, order, by).where("rn = 1").drop("rn")


def random_per_key(df: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    return first_per_key(df, by, [seeded(F.col(key), seed), F.col(key)])


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows; a null predicate rejects, so the two always add up."""
    keep = F.coalesce(predicate, F.lit(False))
    return df.where(keep), df.where(~keep)


def n_per_id(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Ids with at least n rows give exactly n of them, by hash order."""
    # Salted first: a hot id's rows are cut to n in each salt before they meet.
    order = [seeded(F.col(key), seed), F.col(key)]
    some = ranked(df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS))), order, [by, "_salt"], "_r").where(F.col("_r") <= n)
    w = Window.partitionBy(by)
    return some.withColumn("_c", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).where((F.col("_c") >= n) & (F.col("_r") <= n)).drop("_c", "_r", "_salt")


def common_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that occur in every frame."""
    return reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])
