"""Evaluation passages in training messages (problem 1): a prefix-filtered set join.

A passage is a run of at least 12 words of an item with at most two of them changed, dropped or
with a word put in between; in scripts without spaces a run of at least 20 characters.

* Both sides become sequences of normalised tokens; item windows become sets of token shingles.
* A window of 12 words has 10 shingles of three words; two edits destroy at most six, so at least
  four survive (a shingle of five words, usual elsewhere, could lose all).  With the shingles of a
  window ordered by their rarity in the corpus, two of its 8 rarest (10 - 4 + 2) must occur in the
  message: only those are joined.  For characters all 13 shingles of a window must occur, so its two
  rarest are enough.
* Messages are cut into overlapping segments, so that every passage lies inside of one; segments
  without the surviving number of shingles within an item-sized stretch are left out.
* A pair of item and segment is a candidate if two of the joined shingles lie in one window of the
  item and as far from each other in the message, but for the edits (length and positional bound).
  Only candidates meet their texts, and are verified exactly by extending each shared shingle to
  both sides with at most two edits.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.session import cut

WORD_RUN, WORD_EDITS, WORD_SHINGLE = 12, 2, 3
CHAR_RUN, CHAR_SHINGLE = 20, 8
#: Shingles of a window that survive the edits, and the length of its prefix.
SURVIVE = (WORD_RUN - WORD_SHINGLE + 1) - WORD_EDITS * WORD_SHINGLE
MATCHES = 2
PREFIX = (WORD_RUN - WORD_SHINGLE + 1) - SURVIVE + MATCHES
#: New tokens of a segment, and those it shares with its neighbours at either side.
SEGMENT, SHARED = 96, 32
#: Characters of scripts without spaces that make an item a character item.
DENSE = 8

_CF = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85") + "]+")
_TAG = re.compile(r"(?<!<)(?:</?[a-z][^<>]*|<![^<>]+)>(?!>)")
_ESCAPE = re.compile(r"\\[nrt]")
_INNER = re.compile(r"[.,](?<=\d[.,])(?=\d)|['’](?<=[^\W\d_]['’])(?=[^\W\d_])|_")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
#: Han, kana, Thai, Lao, Burmese and Khmer.
_UNSPACED = re.compile(r"[⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff]")


def _plain(text: str) -> str:
    """Text without case, invisible characters, markup and variant forms of characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _CF.sub("", text)
        text = "".join(c if c < "\x80" or not c.isdecimal() else str(unicodedata.decimal(c)) for c in text) if any(c > "\x7f" and c.isdecimal() for c in set(text)) else text
    text = text.casefold()
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    return _INNER.sub("", text)


def words_of(plain: str) -> list[str]:
    return _ASCII_WORD.findall(plain) if plain.isascii() else _WORD.findall(plain)


def is_dense(plain: str) -> bool:
    """Whether a text is written without spaces between words."""
    return not plain.isascii() and len(_UNSPACED.findall(plain)) >= DENSE


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


_hashes = _Hashes()


def word_shingles(tokens: list[str]) -> np.ndarray:
    """Hash of each run of WORD_SHINGLE words."""
    n = len(tokens) - WORD_SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    out = np.zeros(n, np.uint64)
    for k in range(WORD_SHINGLE):
        out = (out ^ h[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def char_shingles(chars: str) -> np.ndarray:
    """Hash of each run of CHAR_SHINGLE characters."""
    n = len(chars) - CHAR_SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full(n, 0x27D4EB2F165667C5, np.uint64)
    for k in range(CHAR_SHINGLE):
        out = (out ^ h[k : k + n]) * _MIX[k % 3]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


class Bitmap:
    """Which shingle hashes can be an item's: no false negatives, of bounded size (at most 32 MB)."""

    def __init__(self, expected: int):
        self.bits = min(28, max(20, int(np.ceil(np.log2(max(expected, 1)))) + 11))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.words = np.zeros(1 << (self.bits - 6), np.int64)

    @classmethod
    def of(cls, hashes: DataFrame) -> "Bitmap":
        """The bitmap of a column ``hash``, put together by the executors; at most 2^22 words come back."""
        made = cls(hashes.count())
        low = F.col("hash").bitwiseAND(int(made.mask))
        words = hashes.select(F.shiftright(low, 6).alias("at"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
        made.words[words["at"].to_numpy()] = words["word"].to_numpy()
        return made

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & self.mask
        return (self.words[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1


def item_table(items: DataFrame) -> DataFrame:
    """item_id, dense, tokens (words by space, or the characters), hashes: of items long enough to hold a
    passage. Items without id or text, and shorter ones, have no passages."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                plain = _plain(text)
                words = words_of(plain)
                dense = is_dense(plain)
                tokens = "".join(words) if dense else " ".join(words)
                if (len(tokens) if dense else len(words)) >= (CHAR_RUN if dense else WORD_RUN):
                    rows.append((key, dense, tokens, (char_shingles(tokens) if dense else word_shingles(words)).tolist()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("item_id").type, pa.bool_(), pa.string(), pa.list_(pa.int64())))], names=["item_id", "dense", "tokens", "hashes"])

    kept = items.select("item_id", "text").where("item_id is not null and text is not null")
    return kept.mapInArrow(run, f"item_id {dict(kept.dtypes)['item_id']}, dense boolean, tokens string, hashes array<bigint>")


def _within(places: np.ndarray, n: int, span: int) -> bool:
    """Whether n of the sorted places lie within a span."""
    return len(places) >= n and bool((places[n - 1 :] - places[: len(places) - n + 1] < span).any())


def segments(at: np.ndarray, h: np.ndarray, tokens, dense: bool):
    """(segment, its tokens, hashes, places in it) of the segments of a message that can hold a passage.

    ``at`` are the places of the shared shingles ``h``. Each segment sees SHARED tokens on either
    side of its own, so a passage that begins inside of it lies inside of it as a whole.
    """
    need, span = (CHAR_RUN - CHAR_SHINGLE + 1, CHAR_RUN) if dense else (SURVIVE, WORD_RUN + WORD_EDITS)
    if not _within(at, need, span):
        return
    for segment in np.unique(at // SEGMENT).tolist():
        first, last = max(0, segment * SEGMENT - SHARED), (segment + 1) * SEGMENT + SHARED
        inside = slice(*np.searchsorted(at, (first, last - (CHAR_SHINGLE if dense else WORD_SHINGLE) + 1)))
        if _within(at[inside], need, span):
            part = tokens[first:last]
            yield segment, part if dense else " ".join(part), h[inside].tolist(), (at[inside] - first).tolist()


def message_hits(rows: DataFrame, bitmap: Bitmap) -> DataFrame:
    """Segments of messages that share shingles with the items: row_id, message_no, segment, dense,
    tokens, hashes, places; and, with a null ``tokens``, how often each hash occurs in a batch."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    source = rows.where("row_id is not null and messages is not null").select("row_id", F.transform("messages", lambda m: m["content"]).alias("contents"))

    def run(batches):
        known = shared.value
        for batch in batches:
            # The words of all messages of a batch make one sequence, whose shingles are looked up
            # at once; those that cross from one message into the next are left out.
            out: list[tuple] = []
            seen: list[np.ndarray] = []
            where, tokens, ends = [], [], [0]
            for key, contents in zip(batch.column("row_id").to_pylist(), batch.column("contents").to_pylist()):
                for no, text in enumerate(contents):
                    if not text or len(text) < CHAR_RUN:
                        continue
                    plain = _plain(text)
                    words = words_of(plain)
                    where.append((key, no))
                    tokens += words
                    ends.append(len(tokens))
                    if is_dense(plain):
                        chars = "".join(words)
                        h = char_shingles(chars)
                        at = np.flatnonzero(known.has(h))
                        if len(at):
                            seen.append(h[at])
                            out += [(key, no, s, True, *rest) for s, *rest in segments(at, h[at], chars, True)]
            h = word_shingles(tokens)
            hits = np.flatnonzero(known.has(h))
            bounds = np.array(ends)
            of = np.searchsorted(bounds, hits, side="right") - 1
            inside = hits + WORD_SHINGLE <= bounds[of + 1] if len(hits) else np.zeros(0, bool)
            hits, of = hits[inside], of[inside]
            seen.append(h[hits])
            for group in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(of)) + 1) if len(hits) else ():
                m = of[group[0]]
                at = hits[group]
                out += [(*where[m], s, False, *rest) for s, *rest in segments(at - bounds[m], h[at], tokens[bounds[m] : bounds[m + 1]], False)]
            distinct, n = np.unique(np.concatenate(seen), return_counts=True)
            out.append((None, None, None, None, None, distinct.tolist(), n.tolist()))
            c = list(zip(*out))
            kinds = (batch.schema.field("row_id").type, pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], names=["row_id", "message_no", "segment", "dense", "tokens", "hashes", "places"])

    kind = dict(source.dtypes)["row_id"]
    return source.mapInArrow(run, f"row_id {kind}, message_no int, segment int, dense boolean, tokens string, hashes array<bigint>, places array<int>")


def prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(hash, dense, item_id, place): the shingles of which each passage keeps at least MATCHES, by rarity."""
    exploded = items.select("item_id", "dense", F.posexplode("hashes").alias("place", "hash"))
    joined = exploded.join(counts, "hash", "left").groupBy("item_id", "dense").agg(F.sort_array(F.collect_list(F.struct("place", "hash", F.coalesce("n", F.lit(0)).alias("n")))).alias("shingles"))

    def run(frames):
        for pdf in frames:
            out = []
            for key, dense, shingles in zip(pdf["item_id"], pdf["dense"], pdf["shingles"]):
                h = [s["hash"] for s in shingles]
                n = [s["n"] for s in shingles]
                width, take = (CHAR_RUN - CHAR_SHINGLE + 1, MATCHES) if dense else (WORD_RUN - WORD_SHINGLE + 1, PREFIX)
                chosen = set()
                for i in range(len(h) - width + 1):
                    chosen.update(sorted(range(i, i + width), key=lambda k: (n[k], h[k]))[:take])
                # A shingle the corpus doesn't have finds nothing.
                out += [(h[k], dense, key, k) for k in chosen if n[k]]
            yield pd.DataFrame(out, columns=["hash", "dense", "item_id", "place"])

    return joined.mapInPandas(run, f"hash bigint, dense boolean, item_id {dict(items.dtypes)['item_id']}, place int")


def _reach(a, b, p: int, q: int, step: int, edits: int) -> list[int]:
    """Most tokens of ``a`` from p on (in the direction of step) that a run ending in a match can
    span with 0, 1, .. edits against ``b`` from q on."""
    best, states, na, nb = [0] * (edits + 1), {(p, q)}, len(a), len(b)
    for e in range(edits + 1):
        ends = set()
        for x, y in states:
            x0 = x
            while 0 <= x < na and 0 <= y < nb and a[x] == b[y]:
                x += step
                y += step
            ends.add((x, y))
            if x != x0:
                best[e] = max(best[e], abs(x - p))
        states = set()
        for x, y in ends:
            inside = 0 <= x < na
            if inside:
                states.add((x + step, y))
            if 0 <= y < nb:
                states.add((x, y + step))
                if inside:
                    states.add((x + step, y + step))
    for e in range(1, edits + 1):
        best[e] = max(best[e], best[e - 1])
    return best


def longest_run(item, text, i: int, j: int, size: int, edits: int) -> int:
    """Longest run of item tokens around the shared shingle item[i:i+size] = text[j:j+size] that
    occurs in the text with at most ``edits`` edits. It begins and ends with a match or at the
    item's border, where the words left over count as edits."""
    if any(item[i + k] != text[j + k] for k in range(size)):
        return 0
    left = _reach(item, text, i - 1, j - 1, -1, edits)
    right = _reach(item, text, i + size, j + size, 1, edits)
    for reach, border in ((left, i), (right, len(item) - i - size)):
        # From the last to the first, as each looks at those of fewer edits.
        for e in range(edits, -1, -1):
            if any(border - reach[k] <= e - k for k in range(e + 1)):
                reach[e] = border
    return size + max(left[e] + right[edits - e] for e in range(edits + 1))


def holds_passage(item, text, anchors: list[tuple[int, int]], dense: bool) -> bool:
    size, edits, need = (CHAR_SHINGLE, 0, CHAR_RUN) if dense else (WORD_SHINGLE, WORD_EDITS, WORD_RUN)
    return any(longest_run(item, text, i, j, size, edits) >= need for i, j in anchors)


#: More shared shingles of one item and segment than these (repetitive texts) are verified without the bound.
BOUND_ANCHORS = 64


def _in_step(anchors):
    """Whether two shingles lie in one window of the item and, but for the edits, as far apart in the
    message: every passage has such."""

    def after(x):
        def near(y):
            places, ats = y["place"] - x["place"], y["at"] - x["at"]
            width, edits = F.when(F.col("dense"), CHAR_RUN - CHAR_SHINGLE + 1).otherwise(WORD_RUN - WORD_SHINGLE + 1), F.when(F.col("dense"), 0).otherwise(WORD_EDITS)
            return (places > 0) & (places < width) & (F.abs(ats - places) <= edits)

        return F.exists(anchors, near)

    return (F.size(anchors) > BOUND_ANCHORS) | F.exists(anchors, after)


def find_leaks(rows: DataFrame, items: DataFrame) -> DataFrame:
    """One row (item_id, row_id) for each item and example of which one message holds a passage.

    Null ids, null lists, null messages and contents, and texts too short for a passage give no
    row; repeated rows and messages give one. Only bounded data are broadcast by hand (the bitmap);
    the joins are left to the optimizer, which splits hot shingles.
    """
    table = cut(item_table(items))
    hits = cut(message_hits(rows, Bitmap.of(table.select(F.explode("hashes").alias("hash")))))
    counts = hits.where("tokens is null").select(F.explode(F.arrays_zip("hashes", "places")).alias("x")).groupBy(F.col("x.hashes").alias("hash")).agg(F.sum("x.places").alias("n"))
    key = ["row_id", "message_no", "segment", "dense"]
    parts = hits.where("tokens is not null")
    probes = parts.select(*key, F.explode(F.arrays_zip("hashes", "places")).alias("hit")).select(*key, F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("at"))
    anchors = probes.join(prefixes(table, counts), ["hash", "dense"]).groupBy("item_id", *key).agg(F.collect_set(F.struct("place", "at")).alias("anchors"))
    found = anchors.where(_in_step(F.col("anchors")))
    texts = parts.select(*key, "tokens").dropDuplicates(key)
    ready = found.join(texts, key).join(table.select("item_id", "dense", F.col("tokens").alias("item_tokens")), ["item_id", "dense"])

    def run(frames):
        for pdf in frames:
            keep = []
            for dense, anchors, text, item in zip(pdf["dense"], pdf["anchors"], pdf["tokens"], pdf["item_tokens"]):
                a, b = (item, text) if dense else (item.split(" "), text.split(" "))
                keep.append(holds_passage(a, b, [(x["place"], x["at"]) for x in anchors], dense))
            yield pdf.loc[keep, ["item_id", "row_id"]]

    kinds = dict(ready.dtypes)
    return ready.select("item_id", "row_id", "dense", "anchors", "tokens", "item_tokens").mapInPandas(run, f"item_id {kinds['item_id']}, row_id {kinds['row_id']}").distinct()
