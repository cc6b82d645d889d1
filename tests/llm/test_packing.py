"""Routing and retrieval of problem 6 against brute force."""

import numpy as np

from mixloom.llm import packing


def corpus_items(spark, sf):
    pieces = packing.cut(packing.pieces_of(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", packing.CAPACITY, None))
    items = pieces.where("container_id is null")
    return items, packing.corpus_of(items.where("n_tokens > 0"))


def neighbours(terms, counts, corpus, query, k=10):
    """BM25 by the formula, item by item."""
    scores = []
    for t, c in zip(terms, counts):
        tf = dict(zip(t.tolist(), c.tolist()))
        norm = packing.K1 * (1 - packing.B + packing.B * c.sum() / corpus.mean)
        scores.append(sum(corpus.idf[x] * tf[x] * (packing.K1 + 1) / (tf[x] + norm) for x in query.tolist() if x in tf))
    return np.array(scores)


def test_neighbours_lie_in_the_items_own_shard(spark, sf):
    items, corpus = corpus_items(spark, sf)
    placed, shards = packing.route(items, corpus)
    t = placed.where("n_tokens > 0").select("id", "shard", "terms", "counts").toArrow().combine_chunks()
    both = packing._items(t.to_batches()[0])
    terms, counts = [x for x, _ in both], [y for _, y in both]
    shard, ids = t["shard"].to_numpy(), t["id"].to_numpy()
    whole = packing.Bm25(terms, counts, corpus)
    recall = []
    for i in range(len(ids)):
        scores = whole.scores([terms[i]])[0]
        assert ids[i] % 50 or np.allclose(scores, neighbours(terms, counts, corpus, terms[i]), rtol=1e-3, atol=1e-3)
        scores[i] = -1
        top = np.argsort(-scores, kind="stable")[:10]
        recall.append(np.mean(shard[top] == shard[i]))
    assert shards > 1 and np.mean(recall) >= 0.9


def test_shards_are_bounded_whatever_the_skew(spark):
    rows = [(i, "the same hot text again and again") for i in range(400)] + [(1000 + i, f"das ist ein anderer Satz Nummer {i} mit Wörtern") for i in range(200)] + [(2000 + i, None) for i in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=64, shard_items=50)
    got = packed.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(k for k, _ in rows)
    used = {}
    for r in got:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 64 and sum(used.values()) / (64 * len(used)) > 0.9
    items = packing.cut(packing.pieces_of(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 64, None))
    placed, shards = packing.route(items, packing.corpus_of(items.where("n_tokens > 0")), 50)
    sizes = [r["count"] for r in placed.where("n_tokens > 0").groupBy("shard").count().collect()]
    assert shards >= 12 and max(sizes) <= 100


def test_similar_clusters_join_up_to_the_bound():
    c = np.array([[1, 0], [0.9, 0.436], [0, 1]], np.float32)
    assert sorted(len(g) for g in packing.merged(c, {0: 5, 1: 5, 2: 5}, 10)) == [1, 2]
    assert len(packing.merged(c, {0: 5, 1: 5, 2: 5}, 9)) == 3
