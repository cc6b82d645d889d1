"""Structured Streaming over rollouts: groups closed by count, staleness by step lag, shard writers.

State is kept a prompt or query, so it is spread over the cluster; each operator's batch
equivalent gives the same rows for the same input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drop_stale(df: DataFrame, training_step: int, model_step: str, max_age: int) -> DataFrame:
    """Results at most ``max_age`` steps old; an unknown step is kept."""
    return df.where(F.coalesce(F.lit(training_step) - F.col(model_step) <= max_age, F.lit(True)))


def keep_finished(df: DataFrame, reason: str = "finish_reason") -> DataFrame:
    return df.where(F.lower(F.col(reason)) == "stop")


def complete_groups(df: DataFrame, prompt: str, sample: str, reward: str, n: int) -> DataFrame:
    """(prompt, group_no, rewards, mean, spread): each n results of a prompt in sample order.

    A group is emitted once its n-th result has arrived; the results over wait in the state.
    """
    kinds = dict(df.dtypes)
    out = f"p {kinds[prompt]}, group_no bigint, rewards array<double>, mean double, spread double"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, waiting = state.get if state.exists else (0, [])
        waiting = [tuple(x) for x in waiting]
        for pdf in frames:
            waiting += list(zip(pdf["s"].tolist(), pdf["r"].tolist()))
        waiting.sort(key=lambda x: x[0])
        rows = []
        while len(waiting) >= n:
            group, waiting = waiting[:n], waiting[n:]
            r = [float(x[1]) for x in group]
            rows.append((key[0], made, r, sum(r) / n, max(r) - min(r)))
            made += 1
        state.update((made, waiting))
        yield pd.DataFrame(rows, columns=["p", "group_no", "rewards", "mean", "spread"])

    source = df.select(F.col(prompt).alias("p"), F.col(sample).alias("s"), F.col(reward).cast("double").alias("r"))
    state = f"made bigint, waiting array<struct<s:{kinds[sample]},r:double>>"
    return source.groupBy("p").applyInPandasWithState(update, out, state, "append", GroupStateTimeout.NoTimeout).withColumnRenamed("p", prompt)


def batch_groups(df: DataFrame, prompt: str, sample: str, reward: str, n: int) -> DataFrame:
    """What ``complete_groups`` emits over all rows at once."""
    d = df.select(prompt, sample, F.col(reward).cast("double").alias("r"), (F.row_number().over(Window.partitionBy(prompt).orderBy(sample)) - 1).alias("k"))
    g = d.groupBy(prompt, F.floor(F.col("k") / n).alias("group_no")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("rewards"))
    return g.where(F.size("rewards") == n).select(prompt, "group_no", "rewards", (F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x) / n).alias("mean"), (F.array_max("rewards") - F.array_min("rewards")).alias("spread"))


def rubric_buffer(df: DataFrame, query: str, rubric: str, weight: str, cap: int) -> DataFrame:
    """The ``cap`` newest active rubrics of each query after each batch: (query, rubrics, retired)."""
    kinds = dict(df.dtypes)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, retired = state.get if state.exists else ([], 0)
        active = [tuple(x) for x in active]
        seen = {x[0] for x in active}
        for pdf in frames:
            for title, w in zip(pdf["r"], pdf["w"]):
                if title not in seen:
                    seen.add(title)
                    active.append((title, float(w)))
        over = max(0, len(active) - cap)
        active, retired = active[over:], retired + over
        state.update((active, retired))
        yield pd.DataFrame([(key[0], [x[0] for x in active], retired)], columns=["q", "rubrics", "retired"])

    source = df.select(F.col(query).alias("q"), F.col(rubric).alias("r"), F.col(weight).cast("double").alias("w"))
    return source.groupBy("q").applyInPandasWithState(update, f"q {kinds[query]}, rubrics array<string>, retired bigint", "active array<struct<r:string,w:double>>, retired bigint", "update", GroupStateTimeout.NoTimeout).withColumnRenamed("q", query)


def windowed_counts(df: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def write_rollouts(df: DataFrame, path: str, checkpoint: str, shard: int = 10_000):
    """Rollouts as JSON lines by batch and shard. A batch that is repeated overwrites its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", shard).json(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def excluded(df: DataFrame, index: str, reward: str, full: float, rate: float) -> DataFrame:
    """Indices solved at the rate, to be left out from now on."""
    return df.groupBy(index).agg(F.avg((F.col(reward) == full).cast("double")).alias("s")).where(F.col("s") >= rate).select(index)


def replenish(df: DataFrame, kept: DataFrame, prompt: str) -> DataFrame:
    """Prompts whose results were consumed or dropped, one row for each next prompt to be asked."""
    return df.select(prompt).distinct().join(kept.select(prompt).distinct().withColumn("kept", F.lit(True)), prompt, "left").select(prompt, F.coalesce("kept", F.lit(False)).alias("kept"))
