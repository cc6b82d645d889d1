"""Decontamination: exact phrases, n-grams and vectors of evaluation texts against training texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.functions.text import ngrams


#: Bytes of query vectors that are broadcast together.
AT_ONCE = 128 << 20


def analyze(x: Column) -> Column:
    """Lower-case tokens between blanks, line breaks, backslashes and common marks."""
    return F.filter(F.split(F.lower(x), r"[ ,.?!:;()\"\-]|\n|\\"), lambda t: t != "")


def user_documents(df: DataFrame, key: str, messages: str = "messages", role: str = "user") -> DataFrame:
    """One document a message of the role: (original_id, place, text)."""
    exploded = df.select(F.col(key).alias("original_id"), F.posexplode(messages).alias("place", "m"))
    return exploded.where((F.col("m.role") == role) & F.col("m.content").isNotNull()).select("original_id", "place", F.col("m.content").alias("text"))


def new_documents(index: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Documents of a batch that the index hasn't yet."""
    return batch.join(index.select(key).distinct(), key, "left_anti")


def exact_matches(docs: DataFrame, doc_key: str, doc_text: str, queries: DataFrame, query_key: str, query_text: str, width: int = 4) -> DataFrame:
    """(doc, query) where all analysed tokens of the query occur as one phrase in the document.

    Candidates share one n-gram of the query, an equi-join: the one that most tells it from the
    other queries, so that openings many queries have in common aren't joined. The phrase is then
    looked up among the candidates only. Queries with fewer tokens than ``width`` join on their
    whole phrase. Null and empty queries match nothing.
    """
    q = queries.select(F.col(query_key).alias("_q"), analyze(F.col(query_text)).alias("_qt")).where(F.size("_qt") > 0)
    q = q.withColumn("_w", F.least(F.size("_qt"), F.lit(width))).withColumn("_p", F.array_join("_qt", " "))
    grams = lambda k: ngrams(F.col("_qt"), k)
    some = F.when(F.col("_w") == width, grams(width))
    for k in range(1, width):
        some = some.when(F.col("_w") == k, grams(k))
    each = q.select("_q", "_w", F.explode(F.array_distinct(some)).alias("_g"))
    shared = each.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    chosen = each.join(shared, "_g").groupBy("_q", "_w").agg(F.min(F.struct("_n", "_g")).alias("m")).select("_q", "_w", F.col("m._g").alias("_g"))
    d = docs.select(F.col(doc_key).alias("_d"), analyze(F.col(doc_text)).alias("_dt"))
    # Documents give n-grams of the widths that occur among the queries only.
    widths = sorted(r[0] for r in q.select("_w").distinct().collect())
    found = d.select("_d", F.explode(F.array_distinct(F.flatten(F.array(*[ngrams(F.col("_dt"), k) for k in widths] or [F.array().cast("array<string>")])))).alias("_g"))
    pairs = found.join(chosen, "_g").select("_d", "_q")
    full = pairs.distinct().join(q.select("_q", "_p"), "_q").join(d.select("_d", F.concat(F.lit(" "), F.array_join("_dt", " "), F.lit(" ")).alias("_t")), "_d")
    return full.where(F.col("_t").contains(F.concat(F.lit(" "), F.col("_p"), F.lit(" ")))).select(F.col("_d").alias(doc_key), F.col("_q").alias(query_key)).distinct()


def ngram_scores(docs: DataFrame, doc_key: str, doc_text: str, queries: DataFrame, query_key: str, query_text: str, n: int = 8) -> DataFrame:
    """(doc, query, score): share of the query's tokens that lie in an n-gram the document has too."""
    q = queries.select(F.col(query_key).alias("_q"), analyze(F.col(query_text)).alias("_qt")).where(F.size("_qt") >= n)
    qg = q.select("_q", F.size("_qt").alias("_len"), F.posexplode(ngrams(F.col("_qt"), n)).alias("_i", "_g"))
    dg = docs.select(F.col(doc_key).alias("_d"), F.explode(F.array_distinct(ngrams(analyze(F.col(doc_text)), n))).alias("_g"))
    hits = dg.join(qg, "_g")
    covered = hits.select("_d", "_q", "_len", F.explode(F.sequence("_i", F.col("_i") + n - 1)).alias("_t")).groupBy("_d", "_q", "_len").agg(F.countDistinct("_t").alias("_c"))
    return covered.select(F.col("_d").alias(doc_key), F.col("_q").alias(query_key), (F.col("_c") / F.col("_len")).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(docs: DataFrame, doc_key: str, doc_vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 5, block: int = 256) -> DataFrame:
    """(query, doc, cosine, score, rank): the k nearest documents of each query, exactly.

    Queries are put together in blocks that meet the documents as matrices, and each task keeps k
    candidates a query, so only those are shuffled. ``score`` maps the cosine to (1 + cos) / 2.
    """
    rows = queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull())
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(query_vector)), F.lit(1))).first()
    # Too many bytes for one broadcast: the queries go in parts, each against all documents.
    parts = -(-n * width * 8 // AT_ONCE) or 1
    found = [_nearest_part(docs, doc_key, doc_vector, rows if parts == 1 else rows.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == i), query_key, query_vector, k, block) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _nearest_part(docs: DataFrame, doc_key: str, doc_vector: str, rows: DataFrame, query_key: str, query_vector: str, k: int, block: int) -> DataFrame:
    import numpy as np

    kinds = dict(docs.dtypes), dict(rows.dtypes)
    local = rows.toPandas()
    keys = list(local[query_key])
    q = np.stack([np.asarray(v, np.float64) for v in local[query_vector]]) if keys else np.zeros((0, 1))
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((keys, q))

    def run(frames):
        import pandas as pd

        keys, q = shared.value
        best: dict = {}
        for pdf in frames:
            ids = list(pdf["d"])
            if not ids or not len(keys):
                continue
            m = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            for at in range(0, len(keys), block):
                s = q[at : at + block] @ m.T
                for i, row in enumerate(s):
                    top = np.argpartition(-row, min(k, len(row) - 1))[:k] if len(row) > k else range(len(row))
                    top = [j for j in range(len(row)) if row[j] >= min(row[list(top)])] if len(row) > k else top
                    mine = best.setdefault(keys[at + i], [])
                    mine += [(-float(row[j]), ids[j]) for j in top]
                    mine.sort()
                    del mine[k:]
        out = [(key, d, -c) for key, found in best.items() for c, d in found]
        yield pd.DataFrame(out, columns=["q", "d", "cosine"])

    near = docs.where(F.col(doc_vector).isNotNull()).select(F.col(doc_key).alias("d"), F.col(doc_vector).alias("v")).mapInPandas(run, f"q {kinds[1][query_key]}, d {kinds[0][doc_key]}, cosine double")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "d")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("q").alias(query_key), F.col("d").alias(doc_key if doc_key != query_key else f"{doc_key}_near"), "cosine", ((1 + F.col("cosine")) / 2).alias("score"), "rank"
    )


def contaminated(scores: DataFrame, doc_key: str, threshold: float) -> DataFrame:
    return scores.where(F.col("score") > threshold).select(doc_key).distinct()


def decontaminate(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key).distinct(), key, "left_anti")


def score_matrix(scores: DataFrame, index: str, evaluation: str, names: list[str] | None = None) -> DataFrame:
    """Mean of the per-query best scores for each (index, evaluation), as a matrix."""
    return scores.groupBy(index).pivot(evaluation, names).agg(F.round(F.avg("score"), 4))
