"""Reward, advantage and loss arithmetic on columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def advantages(df: DataFrame, by: str, reward: str, mode: str = "standard") -> DataFrame:
    """(x - mean) / (population deviation + 1e-8), or x - mean, within each prompt's group."""
    # Aggregates meet the rows in a join, whose hot keys are split; a window would take a group whole.
    groups = df.groupBy(F.col(by).alias("_by")).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_d"))
    centred = F.col(reward) - F.col("_m")
    return df.join(groups, F.col(by).eqNullSafe(F.col("_by"))).withColumn("advantage", centred if mode == "centered" else centred / (F.col("_d") + 1e-8)).drop("_by", "_m", "_d")


def gae(values: Column, rewards: Column, gamma: float = 1.0, lam: float = 1.0, dones: Column | None = None, mask: Column | None = None) -> Column:
    """Generalised advantages of a sequence by a fold from its end; dones end an episode, places
    outside the mask pass the state through and get 0."""
    n = F.size(values)
    order = F.when(n > 0, F.reverse(F.sequence(F.lit(1), n))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast(DOUBLES).alias("out"), F.lit(0.0).alias("last"), F.lit(0.0).alias("next"))

    def step(s, i):
        v, r = F.element_at(values, i), F.element_at(rewards, i)
        live = 1.0 - F.element_at(dones, i).cast("double") if dones is not None else F.lit(1.0)
        delta = r + gamma * s["next"] * live - v
        adv = delta + gamma * lam * live * s["last"]
        new = F.struct(F.concat(F.array(adv), s["out"]).alias("out"), adv.alias("last"), v.alias("next"))
        if mask is None:
            return new
        kept = F.struct(F.concat(F.array(F.lit(0.0)), s["out"]).alias("out"), s["last"].alias("last"), s["next"].alias("next"))
        return F.when(F.element_at(mask, i) == 1, new).otherwise(kept)

    return F.aggregate(order, start, step, lambda s: s["out"])


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased: 1 - C(n-c, k) / C(n, k), and 1 where fewer than k samples failed."""
    product = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None)).when(n - c < k, F.lit(1.0)).otherwise(1.0 - product)


def masked_mean(values: Column, mask: Column, denominator: Column | None = None) -> Column:
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v.cast("double") * m.cast("double")), F.lit(0.0), lambda a, v: a + v)
    n = denominator if denominator is not None else F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    return F.when(n == 0, F.lit(0.0)).otherwise(total / n)


def sequence_logps(logps: Column, labels: Column, average: bool = False) -> Column:
    """Sum (or mean) of the log-probabilities of labels other than -100, labels shifted by one."""
    pairs = F.zip_with(F.slice(logps, F.lit(1), F.greatest(F.lit(0), F.size(logps) - 1)), F.slice(labels, F.lit(2), F.greatest(F.lit(0), F.size(labels) - 1)), lambda p, y: F.when(y != -100, p))
    kept = F.filter(pairs, lambda p: p.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p.cast("double"))
    return total / F.size(kept) if average else total


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def dpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float, smoothing: float = 0.0) -> Column:
    logits = beta * ((pc - pr) - (rc - rr))
    return -log_sigmoid(logits) * (1 - smoothing) - log_sigmoid(-logits) * smoothing


def wpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float, avg_chosen: Column, avg_rejected: Column) -> Column:
    return dpo_loss(pc, pr, rc, rr, beta) * F.least(F.lit(1.0), F.exp(avg_chosen + avg_rejected))


def simpo_loss(pc: Column, pr: Column, beta: float, gamma_ratio: float) -> Column:
    return -log_sigmoid(beta * (pc - pr - gamma_ratio))


def kl_estimates(new: Column, ref: Column) -> Column:
    d = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), new - ref))
    return F.array(d, d * d / 2, F.expm1(-d) + d, F.exp(d) * d)


def clipped_loss(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, kind: str = "dapo") -> Column:
    clipped = F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    if kind == "cispo":
        return -advantage * F.least(F.lit(1 + high), ratio)
    return F.greatest(-advantage * ratio, -advantage * clipped)


def ratio_correction(new: Column, old: Column, cap: float = 2.0) -> Column:
    return F.zip_with(new, old, lambda a, b: F.least(F.lit(cap), F.exp(a - b)))


def first_true(flags: Column) -> Column:
    """Place of the first true from 0, the length if there is none."""
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(F.size(flags))


def token_cost(prompt: Column, completion: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    table = F.create_map(*[x for k, (a, b) in prices.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    return (prompt * table[model][0] + completion * table[model][1]) / 1e6


def combined_reward(score: Column, format_score: Column | None = None, turn_rewards: Column | None = None, aggregate: str = "last", gated: bool = False, finished: Column | None = None, penalty: float | None = None) -> Column:
    """Verifier score with format, turn rewards and the penalty for answers that didn't stop."""
    out = score
    if turn_rewards is not None:
        turns = F.element_at(turn_rewards, -1) if aggregate == "last" else F.aggregate(turn_rewards, F.lit(0.0), lambda a, r: a + r)
        out = out + F.coalesce(turns, F.lit(0.0))
    if format_score is not None:
        out = F.when(format_score == 1, out).otherwise(0.0) if gated else out + format_score
    if finished is not None and penalty is not None:
        out = F.when(finished, out).otherwise(F.lit(penalty))
    return out
