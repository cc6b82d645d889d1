"""Statistics of datasets, rollouts, tools and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (512, 768, 1024, 1536, 2048, 4096)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max of each column, one row each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.*")
    # Everything comes from the counts of each value, which the tasks add up before they meet, so the
    # measures are computed once and no task sees all values.
    counts = long.where("v is not null").groupBy("measure", "v").agg(F.count(F.lit(1)).alias("_n"))
    n, total = F.sum("_n"), F.sum(F.col("v") * F.col("_n"))
    # Measures without a value keep their row.
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "measure string")
    q = [F.percentile("v", F.lit(p), F.col("_n")).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("_n")) - total * total / n) / F.nullif(n - 1, F.lit(0)))
    found = counts.groupBy("measure").agg(n.alias("n"), (total / n).alias("mean"), spread.alias("std"), F.min("v").alias("least"), *q, F.max("v").alias("most"))
    return every.join(found, "measure", "left").na.fill(0, ["n"]).select("measure", "n", "mean", "std", "least", "p25", "p50", "p75", "most")


def over_thresholds(df: DataFrame, column: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    return df.agg(*[F.count_if(F.col(column) > t).alias(f"over_{t}") for t in thresholds], F.count(F.lit(1)).alias("n"))


def longest(df: DataFrame, key: str, length: str, k: int = 100) -> DataFrame:
    return df.select(key, length).orderBy(F.desc(length), key).limit(k)


def category(source: Column, key: Column) -> Column:
    """Source, or the id without its last ``_`` part; of that what follows a slash, else Other."""
    name = F.coalesce(source, F.regexp_replace(key, r"_[^_]*\z", ""))
    return F.when(name.contains("/"), F.element_at(F.split(name, "/"), -1)).otherwise("Other")


def histogram(df: DataFrame, by: str, value: str, edges: list[float]) -> DataFrame:
    """Counts by group and bin; bins are left-closed, the last one closed on both sides."""
    v = F.col(value)
    bin_ = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (v >= edges[i]) & ((v <= edges[i + 1]) if i == len(edges) - 2 else (v < edges[i + 1]))
        bin_ = F.when(inside, i).otherwise(bin_)
    return df.withColumn("bin", bin_).where("bin is not null").groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))


def rare_to_other(df: DataFrame, by: str, least: int, other: str = "Other") -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, by).withColumn(by, F.when(F.col("_n") >= least, F.col(by)).otherwise(other)).drop("_n")


def transform_stats(before: DataFrame, after: DataFrame, source: str, tokens: str, trainable: str) -> DataFrame:
    """Rows before and after by source, filtered rows, upsampling factor and token averages."""
    a = before.groupBy(source).agg(F.count(F.lit(1)).alias("initial"))
    b = after.groupBy(source).agg(F.count(F.lit(1)).alias("final"), F.sum(tokens).alias("tokens"), F.sum(trainable).alias("trainable_tokens"))
    return a.join(b, source, "left").na.fill(0, ["final", "tokens", "trainable_tokens"]).withColumn("filtered", F.greatest(F.lit(0), F.col("initial") - F.col("final"))).withColumn("upsampling", F.col("final") / F.col("initial")).withColumn("avg_tokens", F.when(F.col("final") > 0, F.col("tokens") / F.col("final")))


def token_stats(df: DataFrame, source: str, tokens: str, trainable: str) -> DataFrame:
    """By source: rows, tokens, trainable tokens, rows without trainable ones, shares of all tokens."""
    by = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"), F.sum(trainable).alias("trainable"), F.count_if(F.col(trainable) == 0).alias("without"))
    total = F.sum("tokens").over(Window.partitionBy())
    return by.withColumn("share", 100.0 * F.col("tokens") / total)


def mean_correctness(df: DataFrame, key: str, scores: str) -> DataFrame:
    return df.select(key, F.explode(scores).alias("s")).groupBy(key).agg(F.avg("s").alias("correctness"), F.count("s").alias("n"))


def batch_stats(df: DataFrame, prompt: str, reward: str, model_step: str, step: int, full: float) -> DataFrame:
    """One row: groups, share of groups without spread, mean share solved, model steps and lag."""
    groups = df.groupBy(prompt).agg((F.max(reward) == F.min(reward)).alias("flat"), F.avg((F.col(reward) == full).cast("double")).alias("solved"), F.min(model_step).alias("lo"), F.max(model_step).alias("hi"), F.avg(model_step).alias("mid"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("flat").cast("double")).alias("flat_share"), F.avg("solved").alias("percent_solved"), F.min("lo").alias("step_min"), F.max("hi").alias("step_max"), F.avg("mid").alias("step_mean"), (step - F.avg("mid")).alias("lag"))


def step_metrics(df: DataFrame, reward: str, length: str, finished: Column, full: float) -> DataFrame:
    solved = F.col(reward) == full
    return df.agg(
        F.avg(reward).alias("score"), F.avg(finished.cast("double")).alias("stop_rate"), F.avg(length).alias("length"), F.avg(F.when(solved, F.col(length))).alias("length_solved"), F.avg(F.when(~solved, F.col(length))).alias("length_unsolved"),
        F.min(length).alias("length_min"), F.max(length).alias("length_max"), F.count_if(solved).alias("solved"),
    )


def tool_stats(df: DataFrame, rollout: str, tool: str, ok: str, runtime: str) -> DataFrame:
    """Calls a rollout, failure rate and mean runtime of each tool, and of all (tool null)."""
    rollouts = df.select(rollout).distinct().agg(F.count(F.lit(1)).alias("rollouts"))
    by = df.rollup(tool).agg(F.count(F.lit(1)).alias("calls"), F.avg((~F.col(ok)).cast("double")).alias("failure_rate"), F.avg(runtime).alias("mean_runtime"))
    return by.join(rollouts).withColumn("calls_per_rollout", F.col("calls") / F.col("rollouts")).drop("rollouts")


def env_metrics(df: DataFrame, env: str, info: str) -> DataFrame:
    return df.select(env, F.explode(info).alias("metric", "v")).groupBy(env, "metric").agg(F.avg(F.col("v").try_cast("double")).alias("mean")).where("mean is not null")


def verifier_rewards(df: DataFrame, response: str, verifier: str, score: str) -> DataFrame:
    each = df.groupBy(response, verifier).agg(F.sum(score).alias("s"))
    return each.groupBy(verifier).agg(F.avg("s").alias("mean"), F.avg((F.col("s") > 0).cast("double")).alias("correct_rate"), F.count(F.lit(1)).alias("n"))


def rubric_metrics(df: DataFrame, kind: str, score: Column, weight: Column) -> DataFrame:
    v = score * weight
    return df.groupBy(kind).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))


def merged_metrics(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.avg(value).alias("value"))


#: Formats of timestamps in judgements.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss")


def judged_at(x: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def latest_judgements(df: DataFrame) -> DataFrame:
    """The latest record of each evaluator and instance; equal times: the larger id."""
    w = Window.partitionBy("instance_id", "evaluator").orderBy(F.desc_nulls_last(judged_at(F.col("timestamp"))), F.desc("id"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def preference_key(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(x)), F.lit(""))


def win_rates(df: DataFrame, preference: str = "preference") -> DataFrame:
    """Counts and shares of the five outcomes, and of the merged wins and ties."""
    p = preference_key(F.col(preference))
    d = df.select(p.alias("outcome")).where("outcome is not null")
    merged = F.when(F.col("outcome").startswith("a-is"), "a").when(F.col("outcome").startswith("b-is"), "b").otherwise("tie")
    counts = d.groupBy("outcome", merged.alias("winner")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total).withColumn("winner_share", F.sum("n").over(Window.partitionBy("winner")) / total)


def preference_agreement(df: DataFrame) -> DataFrame:
    """Strict and relaxed agreement of the first two evaluators of each instance; a tie against a
    win counts half in the relaxed one."""
    p = preference_key(F.col("preference"))
    w = Window.partitionBy("instance_id").orderBy(F.asc_nulls_last(judged_at(F.col("timestamp"))), "id")
    side = F.when(p.startswith("a-is"), "a").when(p.startswith("b-is"), "b").otherwise("tie")
    first = df.where(p.isNotNull()).select("instance_id", side.alias("side"), F.row_number().over(w).alias("r")).where("r <= 2")
    pairs = first.groupBy("instance_id").agg(F.max(F.when(F.col("r") == 1, F.col("side"))).alias("x"), F.max(F.when(F.col("r") == 2, F.col("side"))).alias("y")).where("y is not null")
    same = (F.col("x") == F.col("y")).cast("double")
    relaxed = F.when(F.col("x") == F.col("y"), 1.0).when((F.col("x") == "tie") | (F.col("y") == "tie"), 0.5).otherwise(0.0)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(same).alias("strict"), F.avg(relaxed).alias("relaxed"))


def acceptance(df: DataFrame) -> DataFrame:
    """Share of accepted completions by model, each instance's first judgement counting."""
    w = Window.partitionBy("instance_id").orderBy(F.asc_nulls_last(judged_at(F.col("timestamp"))), "id")
    first = df.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    sides = [first.select(F.col(f"model_{s}").alias("model"), F.lower(F.trim(f"completion_{s}_is_acceptable")).alias("ok")) for s in "ab"]
    return sides[0].unionByName(sides[1]).where("ok in ('yes', 'no') and model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ok") == "yes").cast("double")).alias("accepted"))


def eval_summary(df: DataFrame, model: str, task: str, value: str, tasks: list[str]) -> DataFrame:
    return df.groupBy(model).pivot(task, tasks).agg(F.bround(F.avg(value), 4))


def eval_means(df: DataFrame, model: str, task: str, value: str) -> DataFrame:
    """As eval_summary, in long form: one row for each model and task that is found."""
    return df.groupBy(model, task).agg(F.bround(F.avg(value), 4).alias("mean"))


def summary(df: DataFrame, columns: list[str], thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """A row for each column: mean, maximum and the percentage over each threshold."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.*")
    return long.groupBy("measure").agg(F.avg("v").alias("mean"), F.max("v").alias("most"), *[(100 * F.avg((F.col("v") > t).cast("double"))).alias(f"over_{t}_pct") for t in thresholds])


def benchmark_totals(df: DataFrame, tokens: str, seconds: str, measures: list[str]) -> DataFrame:
    """One row: batches, tokens, seconds, tokens a second and the means of the measures."""
    return df.agg(F.count(F.lit(1)).alias("batches"), F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"), (F.sum(tokens) / F.nullif(F.sum(seconds), F.lit(0))).alias("tokens_per_second"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


def counts_by(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """By source: rows, and those that were hit (contaminated, filtered, decided)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


def top_by_spread(df: DataFrame, group: str, kind: str, value: str, k: int) -> DataFrame:
    """The k kinds of largest population deviation in each group; equal ones by name."""
    by = df.groupBy(group, kind).agg(F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("std"), kind)
    return by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sorted_by_score(df: DataFrame, by: str, item: str, score: str) -> DataFrame:
    """Each group's items as a list, best score first, equal ones by item."""
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))), lambda x: x["i"]).alias("items"))


#: Fields and sizes of evaluation sets, as (name, split, fields, limit).
BENCHMARK_FIELDS = ("name", "split", "fields", "row_limit")


def benchmark_items(sources: dict[str, DataFrame], suite: list[tuple[str, str, list[str], int | None]]) -> DataFrame:
    """(eval_set, text) of the named fields of each set of the suite, at most its limit of rows by hash."""
    out = None
    for name, split, fields, limit in suite:
        d = sources[name]
        d = d.where(F.col("split") == split) if "split" in d.columns and split else d
        if limit is not None:
            d = d.orderBy(F.xxhash64(*d.columns)).limit(limit)
        part = d.select(F.lit(name).alias("eval_set"), F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text")).where("text is not null")
        out = part if out is None else out.unionByName(part)
    return out


def length_histogram(df: DataFrame, by: str, lengths: Column, width: int) -> DataFrame:
    """Rows by group and bin of token length; a null length counts as 0."""
    return df.select(by, (F.floor(F.coalesce(lengths, F.lit(0)) / width) * width).alias("from")).groupBy(by, "from").agg(F.count(F.lit(1)).alias("n"))
