"""Mixing sources to target shares (problem 3) by pivotal dependent rounding.

Every example of a source should be used c = min(target / examples, max_repeats) times.  Its whole
part is certain; the fractional parts p are rounded to 0 or 1 so that their sum is kept: two
examples fight, one of them takes or gives mass until it is 0 or 1, the other fights on.  The
examples of a source are spread over leaves of bounded size, each leaf ends with at most one
undecided example, and those meet again on the next level of a reduction tree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.names import dataset_key
from mixloom.session import cut

LEAF = 20_000
FAN = 1_000
EPS = 1e-9


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds probabilities to 0 or 1 pair by pair, keeping their sum; at most one stays between."""
    out = p.astype(float).copy()
    draws = rng.random(len(out))
    fighter = -1
    for i in range(len(out)):
        if out[i] < EPS or out[i] > 1 - EPS:
            out[i] = round(out[i])
            continue
        if fighter < 0:
            fighter = i
            continue
        a, b = out[fighter], out[i]
        s = a + b
        if s < 1:
            winner, loser, rest, gone = (i, fighter, s, 0.0) if draws[i] * s < b else (fighter, i, s, 0.0)
        else:
            winner, loser, rest, gone = (i, fighter, s - 1, 1.0) if draws[i] * (2 - s) < 1 - b else (fighter, i, s - 1, 1.0)
        out[loser] = gone
        if rest < EPS or rest > 1 - EPS:
            out[winner], fighter = round(rest), -1
        else:
            out[winner], fighter = rest, winner
    return out


def _generator(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little"))


def _round_group(level: int, seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        rng = _generator(seed, level, *key)
        p = pivotal(pdf["p"].to_numpy(), rng)
        if last:
            p = np.where(rng.random(len(p)) < p, 1.0, 0.0)
        return pdf.assign(p=p)

    return run


SCHEMA = "mix string, dataset string, row_id bigint, base bigint, leaf bigint, p double"


def examples_of(rows: DataFrame) -> DataFrame:
    """Distinct (row_id, key): every example once under its dataset's clean name. Rows without
    row_id or dataset belong to no mix."""
    return rows.select("row_id", dataset_key(F.col("dataset")).alias("key")).where("row_id is not null and key is not null").distinct()


def plan_of(examples: DataFrame, spec: DataFrame) -> DataFrame:
    """One row for each row of the spec: examples, total, wanted and expected copies of an example.

    A null share counts as 0, a null max_repeats as no limit; a dataset without examples has 0.
    """
    spec = spec.select("mix", "dataset", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", dataset_key(F.col("dataset")).alias("key"))
    counts = examples.groupBy("key").agg(F.count(F.lit(1)).alias("examples"))
    sized = spec.join(counts, "key", "left").na.fill(0, ["examples"])
    totals = sized.select("mix", "key", "examples").distinct().groupBy("mix").agg(F.sum("examples").alias("total"))
    wanted = F.col("target_share") * F.col("total")
    each = F.when(F.col("examples") > 0, F.least(wanted / F.col("examples"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))))).otherwise(F.lit(0.0))
    return sized.join(totals, sized["mix"].eqNullSafe(totals["mix"])).drop(totals["mix"]).select(
        "mix", "dataset", "key", "target_share", "max_repeats", "examples", "total", wanted.alias("wanted"), each.alias("each")
    )


def mix_copies(rows: DataFrame, spec: DataFrame, seed: int = 42, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(plan, copies): copies has mix, dataset (as in the spec), row_id and how often it is used.

    Examples used 0 times are left out. The copies of a source differ from their target by less
    than one, and no example is used more than max_repeats times. The outcome depends on the seed
    and the rows alone, not on partitions. A hot source is spread over leaves by a hash of row_id.
    """
    examples = cut(examples_of(rows))
    plan = cut(plan_of(examples, spec))
    leaves = plan.select(F.max(F.ceil(F.col("examples") / leaf))).first()[0] or 1
    whole = F.floor(F.col("each") + F.lit(EPS))
    spread = examples.join(plan.where("each > 0").select("mix", "dataset", "key", "each", "examples"), "key").select(
        "mix", "dataset", "row_id", whole.cast("bigint").alias("base"),
        F.pmod(F.xxhash64("row_id", F.lit(seed)), F.ceil(F.col("examples") / leaf)).cast("bigint").alias("leaf"),
        F.greatest(F.lit(0.0), F.col("each") - whole).alias("p"),
    )
    settled, level, undecided = [spread.where(F.col("p") <= EPS)], 0, spread.where(F.col("p") > EPS)
    while True:
        last = leaves <= 1
        done = undecided.groupBy("mix", "dataset", "leaf").applyInPandas(_round_group(level, seed, last), SCHEMA)
        if last:
            settled.append(done)
            break
        done = cut(done)
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done.where(~fractional))
        undecided = done.where(fractional).withColumn("leaf", F.floor(F.col("leaf") / fan).cast("bigint"))
        leaves, level = -(-leaves // fan), level + 1
    copies = settled[0]
    for more in settled[1:]:
        copies = copies.unionByName(more)
    used = copies.select("mix", "dataset", "row_id", (F.col("base") + F.when(F.col("p") > EPS, F.round("p")).otherwise(0)).cast("bigint").alias("copies"))
    return plan, used.where("copies > 0")


def mix_shares(plan: DataFrame, copies: DataFrame) -> DataFrame:
    """Target and actual share of each row of the spec.

    ``short`` says that examples x max_repeats is less than the share of the total; ``actual_share``
    is of the copies the whole mix got, null if it got none.
    """
    used = copies.groupBy("mix", "dataset").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    p, u = plan.alias("p"), used.alias("u")
    both = p.join(u, F.col("p.mix").eqNullSafe(F.col("u.mix")) & F.col("p.dataset").eqNullSafe(F.col("u.dataset")), "left").select(
        "p.*", F.coalesce("u.copies", F.lit(0)).alias("copies"), F.coalesce("u.most_repeats", F.lit(0)).alias("most_repeats")
    )
    size = both.groupBy(F.col("mix").alias("of")).agg(F.sum("copies").alias("size"))
    short = F.coalesce(F.col("examples") * F.col("max_repeats") < F.col("wanted"), F.lit(False))
    return both.join(size, F.col("mix").eqNullSafe(F.col("of"))).select(
        "mix", "dataset", "target_share", "max_repeats", "examples", "total", "wanted", "copies", "most_repeats",
        F.when(F.col("size") > 0, F.col("copies") / F.col("size")).alias("actual_share"), short.alias("short"),
    )


def short_sources(shares: DataFrame) -> DataFrame:
    """Rows of the spec whose source can't reach its share; their copies stay below the target."""
    return shares.where(F.col("short") & (F.col("copies") < F.col("wanted"))).select("mix", "dataset")
