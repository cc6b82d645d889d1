"""Filling containers of fixed capacity (problem 6) by lexical retrieval.

The documents are encoded where they lie; only their distinct tokens with counts go on.  A router
fitted on a bounded sample sends each to a lexical cluster, wherever it lies in the corpus, and a
cluster that is too large for one index is dealt out over several shards.  A shard has an inverted
BM25 index, with the document frequencies of the whole corpus, over its items' tokens; the largest
unused item seeds a container, the index ranks the unused neighbours, and the best ones that fit
fill it.  The last place goes to the best neighbour among those that leave next to no room.  Items
of containers that stay underfilled meet those of other shards in a second round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.bpe import encoder, vocabulary_path
from mixloom.session import cut

CAPACITY = 2048
#: Most items of a shard, on average, and shards of which the underfilled containers meet.
SHARD_ITEMS, FAN = 32_768, 64
#: Items the router is fitted on, its dimensions and most clusters.
SAMPLE_ITEMS, DIMENSIONS, MOST_CLUSTERS = 4096, 256, 512
#: Clusters at least so similar (cosine of their centroids) share a shard if it can hold them.
ALIKE = 0.4
#: Seeds that are scored together.
BLOCK = 48
K1, B = 1.2, 0.75
#: Placed items leave the index when less than this share of it is unused.
KEPT = 0.8
#: Below this share of the capacity the last item of a container is chosen by size.
CLOSING = 0.25
#: An item that leaves at most this share of the capacity closes a container.
SLACK = 0.001
#: Containers less full than this go into the second round.
FULL = 0.997
LONG = "id {kind}, piece_no int, first_token bigint, n_tokens bigint, container_id bigint, terms array<int>, counts array<int>"


class Corpus:
    """Document frequencies and mean length over all items; at most one number a vocabulary entry."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean = n, max(mean, 1.0)
        self.idf = np.zeros(int(terms.max()) + 1 if len(terms) else 1, np.float32)
        # Robertson's idf, never below 0: a term of more than half of the items has no weight.
        self.idf[terms] = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))

    @classmethod
    def of(cls, terms: list[np.ndarray], counts: list[np.ndarray]) -> "Corpus":
        every, df = np.unique(np.concatenate(terms) if terms else np.empty(0, np.int32), return_counts=True)
        return cls(len(terms), float(np.mean([c.sum() for c in counts])) if counts else 1.0, every, df)


class Bm25:
    """Inverted index of one shard; postings carry their BM25 weight."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(terms, counts)
        n = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
        term = np.concatenate(terms) if n else np.empty(0, np.int32)
        tf = np.concatenate(counts).astype(np.float32) if n else np.empty(0, np.float32)
        norm = K1 * (1 - B + B * np.array([c.sum() for c in counts], np.float32) / corpus.mean)
        useful = corpus.idf[term] > 0
        doc, term, tf = doc[useful], term[useful], tf[useful]
        # Short numbers are sorted in linear time.
        order = np.argsort(term.astype(np.uint16) if len(term) and term.max() < 1 << 16 else term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        self.n, self.doc = n, doc
        self.vocabulary, self.first, self.df = np.unique(term, return_index=True, return_counts=True)
        self.weight = (corpus.idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        # Long postings are rows of a matrix, at most 8 times the postings in all.
        self.row = np.full(len(self.vocabulary), -1)
        often = np.flatnonzero(self.df * 8 >= n)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n), np.float32)
        for r, t in enumerate(often):
            self.rows[r, self.doc[self.first[t] : self.first[t] + self.df[t]]] = self.weight[self.first[t] : self.first[t] + self.df[t]]

    def often(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query of distinct terms what its frequent terms add to each item's score, and the
        places of the others, which ``whole`` adds."""
        picked = np.zeros((len(queries), len(self.rows)), np.float32)
        rare = []
        for i, terms in enumerate(queries):
            at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1) if len(self.vocabulary) else np.empty(0, np.int64)
            at = at[self.vocabulary[at] == terms] if len(at) else at
            dense = self.row[at] >= 0
            picked[i, self.row[at[dense]]] = 1
            rare.append(at[~dense])
        return list(zip(picked @ self.rows, rare))

    def whole(self, scores: np.ndarray, rare: np.ndarray) -> np.ndarray:
        if len(rare):
            lists = [slice(a, a + n) for a, n in zip(self.first[rare].tolist(), self.df[rare].tolist())]
            doc, weight = np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists])
            scores += np.bincount(doc, weights=weight, minlength=self.n)
        return scores

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Score of each item of the shard for each query of distinct terms, one row a query."""
        return np.array([self.whole(*x) for x in self.often(queries)], np.float32).reshape(len(queries), self.n)

    def keep(self, items: np.ndarray) -> None:
        """Leaves only the items of a mask, numbered anew in the same order; their scores stay."""
        number = np.cumsum(items, dtype=np.int32) - 1
        left = items[self.doc]
        before = np.concatenate([[0], np.cumsum(left)])
        first = before[self.first]
        self.df = before[self.first + self.df] - first
        self.first, self.n = first, int(items.sum())
        self.doc, self.weight = number[self.doc[left]], self.weight[left]
        self.rows = self.rows[:, items]


def fill(sizes: np.ndarray, terms: list, counts: list, capacity: int = CAPACITY, corpus: Corpus | None = None) -> list[list[int]]:
    """Containers (lists of item numbers) of items no larger than the capacity, every item in one.

    Items without tokens join the first container. Ties go to the larger, then to the earlier item,
    so equal input gives equal output. Placed items leave the index from time to time, so that the
    later seeds are scored against what is left only.
    """
    n = len(sizes)
    if not n:
        return []
    # Items by falling size: those that fit a room are the end of the list.
    live = np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]
    index = Bm25([terms[i] for i in live], [counts[i] for i in live], corpus or Corpus.of(terms, counts))
    falling = -sizes[live].astype(np.int64)
    unused = np.ones(len(live), bool)
    made = []
    scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    left_over, slack = len(live), SLACK * capacity
    seed = 0
    while left_over:
        seed += int(np.argmax(unused[seed:]))
        if seed not in scored:
            if left_over < KEPT * len(live):
                index.keep(unused)
                live, falling = live[unused], falling[unused]
                unused, seed = np.ones(len(live), bool), 0
            ahead = np.arange(seed, min(seed + 4 * BLOCK, len(live)))
            ahead = ahead[unused[ahead]][:BLOCK]
            scored = dict(zip(ahead.tolist(), index.often([terms[live[i]] for i in ahead])))
        scores = index.whole(*scored.pop(seed))
        unused[seed] = False
        scores[~unused] = -np.inf
        container, room = [int(live[seed])], capacity + int(falling[seed])
        left_over -= 1
        while room > 0:
            first = int(np.searchsorted(falling, -room))
            some = first + int(np.argmax(unused[first:])) if first < len(live) else first
            if some == len(live) or not unused[some]:
                break
            # Those that leave next to no room; ``some`` is the largest that fits.
            closing = scores[some : np.searchsorted(falling, int(slack) - room, side="right")]
            closes = some + int(np.argmax(closing)) if len(closing) else some
            if room <= CLOSING * capacity:
                best = closes
            else:
                best = some + int(np.argmax(scores[some:]))
                rest = room + int(falling[best])
                if slack < rest <= CLOSING * capacity and len(closing) and np.count_nonzero(unused[np.searchsorted(falling, -rest) :]) <= 1:
                    best = closes
            unused[best] = False
            scores[best] = -np.inf
            container.append(int(live[best]))
            room += int(falling[best])
            left_over -= 1
        made.append(container)
    empty = np.flatnonzero(sizes == 0).tolist()
    if empty:
        made = [made[0] + empty, *made[1:]] if made else [empty]
    return made


class Router:
    """Nearest of a few lexical centroids, fitted on a bounded sample by spherical k-means."""

    def __init__(self, corpus: Corpus, sample: list[tuple[np.ndarray, np.ndarray]], clusters: int, seed: int = 7, rounds: int = 8):
        self.corpus = corpus
        x = self.vectors(sample)
        rng = np.random.default_rng(seed)
        clusters = max(1, min(clusters, len(x)))
        # Each next first centroid is the item farthest from those before.
        chosen = [int(rng.integers(len(x)))] if len(x) else []
        near = x @ x[chosen[0]] if chosen else np.empty(0)
        while chosen and len(chosen) < clusters:
            chosen.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[chosen[-1]])
        self.centroids = x[chosen].copy() if chosen else np.zeros((1, DIMENSIONS), np.float32)
        for _ in range(rounds):
            of = np.argmax(x @ self.centroids.T, axis=1) if len(x) else np.empty(0, int)
            for k in range(len(self.centroids)):
                if (of == k).any():
                    mean = x[of == k].mean(axis=0)
                    self.centroids[k] = mean / max(float(np.linalg.norm(mean)), 1e-9)

    def vectors(self, items: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Normalised tf-idf vectors of the items, hashed with signs to DIMENSIONS places."""
        if not items:
            return np.zeros((0, DIMENSIONS), np.float32)
        row = np.repeat(np.arange(len(items)), [len(t) for t, _ in items])
        term = np.concatenate([t for t, _ in items]).astype(np.int64)
        idf = self.corpus.idf[np.minimum(term, len(self.corpus.idf) - 1)]
        mixed = term * 0x9E3779B1 & 0xFFFFFFFF
        value = np.log1p(np.concatenate([c for _, c in items])) * idf * np.where(mixed >> 31, 1.0, -1.0)
        x = np.bincount(row * DIMENSIONS + (mixed >> 8) % DIMENSIONS, weights=value, minlength=len(items) * DIMENSIONS).reshape(len(items), DIMENSIONS)
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def clusters(self, items: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.argmax(self.vectors(items) @ self.centroids.T, axis=1)


def _items(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    columns = (batch.column(c) for c in ("terms", "counts"))
    return list(zip(*([np.asarray(x.values, np.int32) for x in c] for c in columns)))


def pieces_of(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str | None) -> DataFrame:
    """The pieces of all documents; those that fill a container have it, the others their tokens' counts."""
    path = vocabulary or vocabulary_path()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]

    def run(batches):
        encode = encoder(path).encode
        base, made = (1 << 62) + (TaskContext.get().partitionId() << 36), 0
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array(encode(text), np.int32)
                for piece, first in enumerate(range(0, max(len(ids), 1), capacity)):
                    part = ids[first : first + capacity]
                    at.append(i)
                    if len(part) == capacity:
                        rows.append((piece, first, capacity, base + made, None, None))
                        made += 1
                    else:
                        rows.append((piece, first, len(part), None, *np.unique(part, return_counts=True)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *columns], names=["id", "piece_no", "first_token", "n_tokens", "container_id", "terms", "counts"])

    return source.mapInArrow(run, LONG.format(kind=kind))


def corpus_of(items: DataFrame) -> Corpus:
    """Exact document frequencies; as many rows as the vocabulary has entries at most."""
    n, mean = items.agg(F.count(F.lit(1)), F.coalesce(F.avg("n_tokens"), F.lit(1.0))).first()
    df = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toPandas()
    return Corpus(n, float(mean), df["term"].to_numpy(np.int64), df["df"].to_numpy(np.int64))


def route(items: DataFrame, corpus: Corpus, shard_items: int = SHARD_ITEMS) -> tuple[DataFrame, int]:
    """The items with their ``shard``, and the number of shards. Clusters that are alike share a shard
    as long as it has at most ``shard_items``; a cluster of more items, however large, is dealt out by
    a hash, and items without tokens are dealt out over all shards."""
    spark = items.sparkSession
    drawn = items.where("n_tokens > 0").orderBy(F.xxhash64("terms", "first_token"), F.hash("counts")).limit(SAMPLE_ITEMS).select("terms", "counts").toArrow()
    wanted = min(MOST_CLUSTERS, max(16, -(-4 * corpus.n // shard_items)), -(-corpus.n // 64))
    centroids = Router(corpus, _items(drawn), wanted)
    router = spark.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            yield batch.append_column("cluster", pa.array(router.value.clusters(_items(batch)), pa.int32())) if batch.num_rows else batch.append_column("cluster", pa.array([], pa.int32()))

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    placed = items.mapInArrow(run, schema + ", cluster int")
    sizes = placed.where("n_tokens > 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()
    parts, first, total = {}, {}, 0
    for group in merged(centroids.centroids, {r["cluster"]: r["n"] for r in sizes}, shard_items):
        need = -(-sum(n for _, n in group) // shard_items)
        for cluster, _ in group:
            parts[cluster], first[cluster] = need, total
        total += need
    total = max(total, 1)
    spread = F.xxhash64("terms", "id", "piece_no", "first_token")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("cluster")] if d else F.lit(1)
    shard = F.when(F.col("n_tokens") > 0, table(first) + F.pmod(spread, table(parts))).otherwise(F.pmod(spread + F.monotonically_increasing_id(), F.lit(total)))
    return placed.withColumn("shard", shard.cast("bigint")).drop("cluster"), total


def merged(centroids: np.ndarray, sizes: dict[int, int], most: int) -> list[list[tuple[int, int]]]:
    """Groups of (cluster, size): the most similar ones join first, as long as a group has at most ``most`` items."""
    groups = {k: [(k, n)] for k, n in sizes.items()}
    of = {k: k for k in sizes}
    alike = centroids @ centroids.T
    pairs = sorted(((-float(alike[a, b]), a, b) for a in sizes for b in sizes if a < b and alike[a, b] >= ALIKE))
    for _, a, b in pairs:
        x, y = groups[of[a]], groups[of[b]]
        if x is not y and sum(n for _, n in x) + sum(n for _, n in y) <= most:
            gone = of[b]
            for k, _ in y:
                of[k] = of[a]
            x += groups.pop(gone)
    return list(groups.values())


def _packer(capacity: int, shared, base: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece_no", "ascending")]).combine_chunks()
        items = _items(table.to_batches()[0]) if table.num_rows else []
        sizes = table.column("n_tokens").to_numpy()
        of = np.full(len(sizes), -1, np.int64)
        for no, container in enumerate(fill(sizes, [t for t, _ in items], [c for _, c in items], capacity, shared.value)):
            if last or sizes[container].sum() >= FULL * capacity or not sizes[container].any():
                of[container] = base + (key[0].as_py() << 32) + no
        open_ = of < 0
        ids = pa.array(of, pa.int64(), mask=open_)
        lists = [pa.array([x[k] if w else None for x, w in zip(items, open_)], pa.list_(pa.int32())) for k in (0, 1)]
        names = ["id", "piece_no", "first_token", "n_tokens"]
        return pa.table([*(table.column(c) for c in names), ids, *lists, table.column("shard")], names=[*names, "container_id", "terms", "counts", "shard"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row for each piece of a document: id, piece_no, container_id, first_token, n_tokens.

    * A document of at most ``capacity`` tokens is one piece; a longer one is cut into full
      containers and a rest, which is packed like a document.
    * Null and empty texts are one piece of 0 tokens in some container.
    * Each row is packed by itself, also if its id or text is repeated or its id null.
    * The texts aren't shuffled, only the distinct tokens of the items, once; a shard has about
      ``shard_items`` items, so memory has a bound. Container ids are unique.
    """
    pieces = cut(pieces_of(df, id_col, text_col, capacity, vocabulary))
    items = pieces.where("container_id is null")
    corpus = corpus_of(items.where("n_tokens > 0"))
    shared = df.sparkSession.sparkContext.broadcast(corpus)
    placed, shards = route(items, corpus, shard_items)
    schema = ", ".join(f"`{n}` {t}" for n, t in placed.dtypes)
    # More tasks than shards, so that few shards meet in one.
    tasks = min(4 * shards, 20_000)
    once = cut(placed.repartition(tasks, "shard").groupBy("shard").applyInArrow(_packer(capacity, shared, 0, shards == 1), schema))
    out = ["id", "piece_no", "container_id", "first_token", "n_tokens"]
    packed = pieces.where("container_id is not null").select(*out).unionByName(once.where("container_id is not null").select(*out))
    if shards > 1:
        groups = -(-shards // FAN)
        rest = once.where("container_id is null").withColumn("shard", F.pmod("shard", F.lit(groups)))
        packed = packed.unionByName(rest.groupBy("shard").applyInArrow(_packer(capacity, shared, 1 << 61, True), schema).select(*out))
    return packed.withColumnRenamed("id", id_col)


def split_documents(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of which the packing made more than one piece."""
    return packed.where(F.col("piece_no") == 1).select(id_col)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, documents' pieces, tokens, unused tokens and the share that is filled."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.lit(capacity) - F.col("used")), F.lit(0)).alias("unused"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill_rate"),
    )
