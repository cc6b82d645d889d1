"""Queries answer for every row."""

import string
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mixloom.functions import text as T
from mixloom.plans import catalogue


def test_rows_and_outputs_of_every_prompt(spark, sf):
    q = catalogue.queries()
    outputs = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/completions.parquet").select("prompt_id", "gen_id").collect():
        outputs[r["prompt_id"]].add(r["gen_id"])
    rows = {(r["row_id"], r["prompt_id"]) for r in spark.read.parquet(f"{sf}/train_rows.parquet").select("row_id", "prompt_id").collect()}
    pairs = Counter((k, g, len(outputs[p])) for k, p in rows if p is not None for g in outputs.get(p, ()))
    got = q["outputs_per_row"](spark, sf).join(q["prompt_outputs"](spark, sf), "prompt_id").select("row_id", "gen_id", "num_outputs")
    assert Counter(map(tuple, got.collect())) == pairs


def test_every_evaluator_has_a_mean(spark, sf):
    q = catalogue.queries()
    judged = spark.read.parquet(f"{sf}/human_evals.parquet").select("model_a", "evaluator").distinct().collect()
    got = {(r["model_a"], r["evaluator"]): r["mean"] for r in q["eval_summary_long"](spark, sf).collect()}
    assert set(got) == set(map(tuple, judged)) and len({e for _, e in got}) > 2


def test_every_item_is_normalised(spark, sf):
    q = catalogue.queries()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()}
    got = {r["item_id"]: r["x"] for r in q["normalized_answers_all"](spark, sf).collect()}
    assert set(got) == set(items) and any(x and not x.isascii() for x in got.values())


def test_normalised_texts_against_brute_force(spark):
    def brute(text):
        if text is None:
            return None
        kept = "".join(c for c in text.lower() if c not in string.punctuation)
        words, word = [], ""
        for c in kept + " ":
            if c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M":
                word += c
            else:
                words += ["" if word in ("a", "an", "the") else word, c]
                word = ""
        return " ".join("".join(x or " " for x in words).split())

    texts = [None, "", "The Straße, à la carte", "Ein Haus an der Elbe!", "什么都没有变。the end", "l'été a été", "Éa the x", "аn an", "“The” end", "the-the a.", "naïve ań an"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = dict(map(tuple, rows.select("i", T.normalize_answer(F.col("x")).alias("y")).collect()))
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_fresh_days_keep_their_share(spark, sf, tmp_path):
    """The same month with tenfold events is as fresh: the share that is taken doesn't shrink."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = e.count()
    many = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("event_id", F.col("event_id") + F.col("k") * n).drop("k")
    many.write.parquet(f"{tmp_path}/events.parquet")
    q = catalogue.queries()["rollout_batch_days"]
    assert 0 < q(spark, sf).count() < n and q(spark, str(tmp_path)).count() == 10 * q(spark, sf).count()
