"""Preference pairs, rejection sampling and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.operators.mixing import seeded


def binarize(df: DataFrame, by: str, response: str, score: Column, order: str, min_score: float | None = None, margin: float = 0.0) -> DataFrame:
    """Best against worst response of each group of at least two: (by, chosen, rejected, scores).

    Scores are rounded half-even to 2 places; of equal scores the first in ``order`` is best and
    the last is worst. Ties, weak best scores and small margins give no pair.
    """
    scored = df.withColumn("_s", F.bround(score, 2)).where("_s is not null")
    w = Window.partitionBy(by)
    ranked = scored.withColumn("_best", F.row_number().over(w.orderBy(F.desc("_s"), F.asc(order)))).withColumn("_worst", F.row_number().over(w.orderBy(F.asc("_s"), F.desc(order)))).withColumn("_n", F.count(F.lit(1)).over(w))
    pairs = ranked.where("_n >= 2 and (_best = 1 or _worst = 1)").groupBy(by).agg(
        F.max(F.when(F.col("_best") == 1, F.col(response))).alias("chosen"), F.max(F.when(F.col("_worst") == 1, F.col(response))).alias("rejected"),
        F.max("_s").alias("chosen_score"), F.min("_s").alias("rejected_score"),
    )
    keep = (F.col("chosen_score") > F.col("rejected_score")) & (F.col("chosen_score") - F.col("rejected_score") >= margin)
    if min_score is not None:
        keep = keep & (F.col("chosen_score") >= min_score)
    return pairs.where(keep)


def weighted(aspects: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in aspects.items():
        total = total + F.col(name) * weight
    return total


def mean_of(aspects: list[str]) -> Column:
    total = F.lit(0.0)
    for name in aspects:
        total = total + F.col(name)
    return total / len(aspects)


def ranked_pair(df: DataFrame, by: str, response: str, rank: str, key: str, top: int = 4, seed: int = 42) -> DataFrame:
    """Chosen: a hash-chosen one of the ``top`` ranks; rejected: a hash-chosen other response."""
    w = Window.partitionBy(by)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(rank, key))).withColumn("_h", seeded(F.col(key), seed))
    d = d.withColumn("_c", F.row_number().over(w.orderBy(F.when(F.col("_r") <= top, 0).otherwise(1), "_h", key)))
    d = d.withColumn("_x", F.row_number().over(w.orderBy(F.when(F.col("_c") == 1, 1).otherwise(0), F.desc("_h"), key)))
    return d.groupBy(by).agg(F.max(F.when(F.col("_c") == 1, F.col(response))).alias("chosen"), F.max(F.when((F.col("_x") == 1) & (F.col("_c") != 1), F.col(response))).alias("rejected")).where("chosen is not null and rejected is not null and chosen <> rejected")


def aspect_ratings(df: DataFrame, by: str, aspect: str, ratings: str) -> DataFrame:
    """(by, place, rating): mean over aspects of the numbers at each place of comma lists; what is no
    number counts -1, missing places count nothing."""
    parts = df.select(by, aspect, F.posexplode(F.split(F.col(ratings), r"\s*,\s*")).alias("place", "v"))
    return parts.withColumn("v", F.coalesce(F.col("v").try_cast("double"), F.lit(-1.0))).groupBy(by, "place").agg(F.avg("v").alias("rating"))


def argmax_first(df: DataFrame, by: str, place: str, value: str, first: int = 4) -> DataFrame:
    return df.where(F.col(place) < first).groupBy(by).agg(F.min_by(place, F.struct(-F.col(value), F.col(place))).alias("chosen"))


def collect_group(df: DataFrame, by: str, item: str, key: str, n: int = 4, seed: int = 42) -> DataFrame:
    """n hash-chosen items a group, as a list in key order."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(seeded(F.col(key), seed), key))).where(F.col("_r") <= n)
    return ranked.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(key, item))), lambda s: s[item]).alias("items"))


def best_worst(df: DataFrame, by: str, score: str, place: str) -> DataFrame:
    """(by, best, worst, n): places of the highest and lowest score, the first of equals."""
    return df.groupBy(by).agg(F.min_by(place, F.struct(-F.col(score), F.col(place))).alias("best"), F.min_by(place, F.struct(F.col(score), F.col(place))).alias("worst"), F.count(F.lit(1)).alias("n"))


def model_scores(df: DataFrame, by: str, model: str, score: str) -> DataFrame:
    return df.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(model, score)))).alias("scores"))


def majority(df: DataFrame, by: str, vote: str, order: str, seed: int = 42) -> DataFrame:
    """Most common vote; of equals the one given first; if all differ, a hash-chosen one."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(by, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(by)
    c = counts.withColumn("most", F.max("n").over(w)).withColumn("kinds", F.count(F.lit(1)).over(w))
    random = (F.col("most") == 1) & (F.col("kinds") > 1)
    c = c.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), F.when(random, seeded(F.concat(F.col(by).cast("string"), F.col(vote).cast("string")), seed)).otherwise(F.lit("")), "first")))
    return c.where("rn = 1").select(by, F.col(vote).alias("winner"), F.col("n").alias("votes"))


def all_pairs(df: DataFrame, by: str, place: str, value: str) -> DataFrame:
    """Unordered pairs of a group's completions: groups are prompts with a few samples each."""
    a, b = df.select(by, F.col(place).alias("a"), F.col(value).alias("a_value")), df.select(by, F.col(place).alias("b"), F.col(value).alias("b_value"))
    return a.join(b, by).where("a < b")


def reward_accuracy(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    d = F.col(chosen) - F.col(rejected)
    return df.agg(F.avg((d > 0).cast("double")).alias("accuracy"), F.avg(d).alias("margin"), F.avg(F.log1p(F.exp(-d))).alias("loss"), F.count(F.lit(1)).alias("n"))
