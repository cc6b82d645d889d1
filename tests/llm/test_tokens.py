import base64
import random

import pytest
from pyspark.sql import functions as F

from mixloom.llm import packing, tokens
from mixloom.llm.bpe import encoder, vocabulary_path

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, ids string, id string"


def reference():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_reference_on_random_texts():
    own, ref = encoder(vocabulary_path()), reference()
    rng = random.Random(5)
    alphabet = "aeiou thsrnmg ABCäß中文字🙂กกि  \n\t'0123.,<|endoftext|>\x1c\x85​ 　"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert own.encode(s) == ref.encode_ordinary(s), s
        assert own.count(s) == len(own.encode(s))


def test_encoder_is_exact_on_very_long_runs():
    own, ref = encoder(vocabulary_path()), reference()
    for s in ("a" * 50_000, "ab" * 20_000, " " * 3_000, "漢字" * 5_000, "x1" * 10_000):
        assert own.encode(s) == ref.encode_ordinary(s)


def test_lone_surrogates_dont_crash():
    assert encoder(vocabulary_path()).encode("a\ud800b")


def test_encode_texts_edge_cases(spark):
    rows = [(1, "hello world", "x", "y"), (2, "", None, None), (3, None, None, None), (None, "hello world", None, None), (1, "hello world", "x", "y"), (4, "<|endoftext|>", None, None)]
    out = tokens.encode_texts(spark.createDataFrame(rows, SCHEMA))
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = out.collect()
    assert len(got) == 6
    assert sorted(len(r["ids"]) for r in got)[:2] == [0, 0] and all(r["ids"] is not None for r in got)
    assert [r["ids"] for r in got if r["doc_id"] == 4] != [[50256]]
    assert tokens.encode_texts(spark.createDataFrame([], SCHEMA)).collect() == []


TRAIN = "row_id bigint, dataset string, lang string, messages array<struct<role:string,content:string>>, domain string, n_tokens string"


def test_budget_counts_an_example_once(spark):
    m = [("user", "hello world"), ("assistant", None), ("assistant", "")]
    rows = [(1, "own/A-b ", "EN", m, None, None), (1, None, "", m, None, None), (2, "a b", "de", None, None, None), (3, None, None, [], None, None), (4, "zz", "fr", [None, ("user", "x")], None, None), (None, "a_b", "en", m, None, None)]
    info = spark.createDataFrame([("a_b", "chat")], "dataset string, domain string")
    df = spark.createDataFrame(rows, TRAIN)
    each = {r["row_id"]: r for r in tokens.example_tokens(df).collect()}
    assert each[1]["n_tokens"] == 2 and each[1]["dataset"] == "a_b" and each[1]["lang"] == "en" and each[1]["n_messages"] == 3
    assert each[2]["n_tokens"] == 0 and each[3]["n_tokens"] == 0 and each[4]["n_tokens"] == 1 and each[None]["n_tokens"] == 2 and len(each) == 5
    total = tokens.token_budget(df, info).collect()
    assert [r["n_tokens"] for r in total if r["level"] == "all"] == [5]
    assert {(r["domain"], r["n_examples"]) for r in total if r["level"] == "domain"} == {("chat", 3), ("(none)", 2)}
    empty = tokens.token_budget(spark.createDataFrame([], TRAIN), info).collect()
    assert empty == []


def test_budget_equals_brute_force(spark, sf):
    t = spark.read.parquet(f"{sf}/train_rows.parquet")
    got = {r["row_id"]: r["n_tokens"] for r in tokens.example_tokens(t).collect()}
    ref = reference()
    want = {r["row_id"]: sum(len(ref.encode_ordinary(m["content"] or "")) for m in (r["messages"] or []) if m) for r in t.collect()}
    assert got == want


def test_emissions_are_the_longest_matches():
    from mixloom.llm.emissions import LongestMatch, counter

    rng = random.Random(4)
    for _ in range(200):
        tokens = list("abc") + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 12))]
        ranks = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        match = LongestMatch(ranks)
        text = "".join(rng.choice("abc") for _ in range(60))
        want, at = [], 0
        while at < len(text):
            n = max(k for k in range(1, 7) if text[at : at + k] in ranks and at + k <= len(text))
            want.append(ranks[text[at : at + n]])
            at += n
        assert match.tokens(text) == want
    with pytest.raises(ValueError):
        LongestMatch({"ab": 0, "a": 1})
    own, ref = counter(vocabulary_path()), reference()
    for _ in range(2000):
        s = "".join(rng.choice("aeiou thsrnmg ABCäß中文字🙂กกि  \n\t'0123.,") for _ in range(rng.randint(0, 60)))
        assert own.count(s) == len(ref.encode_ordinary(s)), s
    for s in ("a" * 50_000, "ab" * 20_000, " " * 3_000, "漢字" * 5_000):
        assert own.count(s) == len(ref.encode_ordinary(s))


def check_packing(rows, counts, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert max(used.values()) <= capacity
    for d, n in counts.items():
        p = sorted(pieces[d], key=lambda r: r["piece_no"])
        assert sum(x["n_tokens"] for x in p) == n
        assert [x["first_token"] for x in p] == [capacity * i for i in range(len(p))]
        assert len(p) == max(1, -(-n // capacity))
    return used


def test_packing_fills_containers(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    counts = {r["doc_id"]: len(r["ids"]) for r in tokens.encode_texts(d).collect()}
    packed = packing.pack(d)
    rows = packed.collect()
    used = check_packing(rows, counts, packing.CAPACITY)
    assert len(used) <= -(-sum(counts.values()) // packing.CAPACITY) + 1
    assert {r["doc_id"] for r in packing.split_documents(packed).collect()} == {k for k, n in counts.items() if n > packing.CAPACITY}


def test_packing_edge_cases(spark):
    rows = [(1, None, "", ""), (2, "", "", ""), (3, "word " * 5000, "", ""), (4, "x", "", ""), (5, "x", "", ""), (6, "a b c " * 700, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    out = packing.pack(df, capacity=512).collect()
    counts = {r["doc_id"]: len(r["ids"]) for r in tokens.encode_texts(df).collect()}
    check_packing(out, counts, 512)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    only = packing.pack(spark.createDataFrame(rows[:2], SCHEMA).coalesce(1)).collect()
    assert len(only) == 2 and all(r["n_tokens"] == 0 for r in only)
    assert packing.fill_report(packing.pack(df)).first()["pieces"] >= 6


def test_packing_prefers_lexical_neighbours():
    import numpy as np

    terms = [np.array(x, np.int32) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5], [1, 3, 4], [6, 10, 11], [12, 13, 14])]
    ones = [np.ones(3, np.int64)] * 7
    made = packing.fill(np.array([50, 49, 30, 29, 19, 20, 20]), terms, ones, 100)
    first = next(c for c in made if 0 in c)
    assert 2 in first


def test_counts_are_narrow(spark, sf):
    plan = tokens.encode_texts(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert F is not None
