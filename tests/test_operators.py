import json
import os

import pytest
from pyspark.sql import functions as F

from mixloom.functions import following as I
from mixloom.functions import rl
from mixloom.functions import text as T
from mixloom.functions import verifiers as V
from mixloom.functions.names import dataset_key, lang_key
from mixloom.operators import decontam, filters, joins, messages, mixing, packing, preference, repetition, tokenize
from mixloom.plans import registry
from mixloom.sources import io
from mixloom.streaming import rollouts

M = "array<struct<role:string,content:string>>"


def one(spark, expr, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_mixer_parsing_and_sizes():
    assert mixing.parse_mixer(["a", "0.5", "b", "0.25"]) == {"a": 0.5, "b": 0.25}
    assert mixing.parse_mixer(["a", "100", "b", "200"]) == {"a": 100, "b": 200}
    assert mixing.parse_mixer(["a", "1.0", "b", "3"]) == {"a": 1.0, "b": 3}
    for bad in (["a"], [1, "2"]):
        with pytest.raises(ValueError):
            mixing.parse_mixer(bad)
    assert mixing.target_size(1, 100) == 1 and mixing.target_size(1.0, 100) == 100
    with pytest.raises(ValueError, match="cannot be negative"):
        mixing.combined_size(-0.5, 10)


@pytest.mark.parametrize("a,b,n", [(1.0, 1.0, 200), (0.5, 0.5, 100), (0.7, 0.3, 100), (0.0, 1.0, 100), (25, 50, 75), (0.4, 10, 50)])
def test_combined_sizes(spark, a, b, n):
    x = spark.range(100)
    assert mixing.combine({"p": (x, "id", a), "q": (x, "id", b)}).count() == n


def test_dense_index_and_upsample(spark):
    d = mixing.dense_index(spark.range(1000).repartition(7), [F.desc("id")])
    assert [r["index"] for r in d.orderBy(F.desc("id")).collect()] == list(range(1000))
    up = mixing.upsample(spark.range(7), "id", 17)
    assert up.count() == 17 and max(r["count"] for r in up.groupBy("id").count().collect()) == 3
    assert mixing.upsample(spark.range(0), "id", 5).count() == 0


def test_legacy_mix(spark):
    a, b = spark.range(10).withColumn("t", F.lit("x")), spark.range(10)
    out = mixing.legacy_mix({"a": (a, "id", 0.5), "b": (b, "id", 1.0)}, ["t"])
    assert out.count() == 15 and out.where("t is null").count() == 10
    with pytest.raises(ValueError):
        mixing.legacy_mix({"a": (a, "id", 0.5), "b": (b, "id", 3)}, ["t"])


@pytest.mark.parametrize("raw,want", [("Own/Name-A ", "name_a"), ("\tNAME a\xa0", "name_a"), ("", None), (None, None)])
def test_dataset_keys(spark, raw, want):
    assert one(spark, dataset_key(F.col("x")), raw) == want


@pytest.mark.parametrize("raw,want", [("en-US", "en"), ("English", "en"), ("fr_CA", "fr"), ("", "und"), (None, "und"), ("unknown", "und"), ("DEU", "de")])
def test_lang_keys(spark, raw, want):
    assert one(spark, lang_key(F.col("x")), raw) == want


@pytest.mark.parametrize("x,label,want", [("The answer is -3", "-3", 1), ("it is +7", "+7", 1), ("so -3.5", "-3.5", 1), ("it is 3", "-3", 0), ("1,234", "1234", 1), ("none", "none", 1)])
def test_gsm8k(spark, x, label, want):
    assert one(spark, V.gsm8k(F.col("x"), F.lit(label)), x) == want


@pytest.mark.parametrize("x,label,want", [("The answer is 42", "answer is 42", 1), ("<think>no</think>Paris", "paris", 1), ("Wrong answer", "correct answer", 0)])
def test_puzzle(spark, x, label, want):
    assert one(spark, V.puzzle(F.col("x"), F.lit(label)), x) == want


def test_f1_and_labels(spark):
    assert abs(one(spark, V.string_f1(F.col("x"), F.array(F.lit("hello"))), "hello world") - 2 / 3) < 1e-9
    assert one(spark, V.string_f1(F.col("x"), F.array(F.lit("goodbye"))), "hello world") == 0
    assert one(spark, V.string_f1(F.col("x"), F.array(F.lit("no"), F.lit("hello world"))), "hello world") == 1
    assert one(spark, V.re_search_f1(F.col("x"), F.lit('["a b"]')), "<finish>zz</finish>") == 0.1
    assert one(spark, V.re_search_f1(F.col("x"), F.lit('["a b"]')), "a b") == 0
    assert one(spark, V.re_search(F.col("x"), F.lit('["A b"]')), "<Finish>a B</finish>") == 1


@pytest.mark.parametrize("x,label,want", [("so \\boxed{\\frac{1}{2}}", "1/2", 1), ("\\boxed{0.5}", "\\frac{1}{2}", 1), ("it is $x=3$", "3", 1), ("\\boxed{4}", "5", 0), ("Final Answer: The final answer is 7. I hope it is correct.", "7", 1)])
def test_math(spark, x, label, want):
    assert one(spark, V.math(F.col("x"), F.lit(label)), x) == want


def test_boxed():
    assert V.last_boxed("a \\boxed{1} b \\boxed{{2}+{3}}") == "{2}+{3}"
    assert V.last_boxed("none") is None and V.last_boxed("\\boxed{open") is None


def test_instruction_functions(spark):
    x = F.col("x")
    assert one(spark, I.keyword_frequency(x, "a", 2), "a b A.")
    assert one(spark, I.paragraph_count(x, 2), "one\n* * *\ntwo") and not one(spark, I.paragraph_count(x, 2), "one\n* * *\n")
    assert one(spark, I.sentence_constraint(x, 3, "at least"), "One. Two? Three. Four") and not one(spark, I.word_constraint(x, 3, "near"), "a b c")
    assert one(spark, I.json_format(x), '{"a": 1}') and not one(spark, I.json_format(x), '{"a": 1} x')
    assert one(spark, I.number_paragraphs(x, 2), "a\n***\nb") and not one(spark, I.number_paragraphs(x, 3), "a\n***\n\n***\nb")
    assert one(spark, I.copies_times(x, F.lit("Hi"), 2), "hi******HI ")
    assert one(spark, I.counting_composition(x, 1, 2), "a b. *** c d. *** e f.")
    assert one(spark, I.repeat_phrase(x, "the quick fox", 1), "the slow fox") and not one(spark, I.repeat_phrase(x, "the quick fox", 1), "the quick fox")
    assert one(spark, I.titled(x), "<<A title>>") and not one(spark, I.titled(x), "<< >>")
    with pytest.raises(ValueError):
        I.letter_frequency(x, "ab", 1)
    assert len(I.FUNCTIONS) == 25 and len(I.CHECKS) == 54


def test_message_formats(spark):
    df = spark.createDataFrame([("\n\nHuman: hi\n\nAssistant: yo\n\nHuman: ok",)], "x string")
    got = df.select(messages.parse_transcript(F.col("x")).alias("m")).first()["m"]
    assert [tuple(m) for m in got] == [("user", "hi"), ("assistant", "yo"), ("user", "ok")]
    turns = spark.createDataFrame([([("human", "a"), ("gpt", "b")],)], "t array<struct<from:string,value:string>>")
    assert [tuple(m) for m in turns.select(messages.from_conversations(F.col("t")).alias("m")).first()["m"]] == [("user", "a"), ("assistant", "b")]
    bad = spark.createDataFrame([([("alien", "a")],)], "t array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="unknown role"):
        bad.select(messages.from_conversations(F.col("t"))).collect()
    c = one(spark, messages.multiple_choice(F.col("x"), F.array(F.lit("apple"), F.lit("Zoo"))), "Berry")
    assert c["letter"] == "B" and c["options"] == ["apple", "Berry", "Zoo"]


def test_tree_paths(spark):
    rows = [(1, None, "user", "q", 0.0, False), (2, 1, "assistant", "a", 0.9, False), (3, 1, "assistant", "b", 0.8, False), (4, 1, "assistant", "c", 0.1, False), (5, 2, "user", "more", 0.5, False), (6, 5, "assistant", "end", 0.5, False), (7, 3, "user", "x", 0.1, True)]
    df = spark.createDataFrame(rows, "id int, parent_id int, role string, text string, quality double, deleted boolean")
    got = {r["id"]: [m["content"] for m in r["messages"]] for r in messages.tree_paths(df).collect()}
    assert got == {3: ["q", "b"], 6: ["q", "a", "more", "end"]}


def test_split_long(spark):
    m = [("user", "a b"), ("assistant", "c d"), ("user", "e"), ("assistant", "f"), ("user", "g " * 50), ("assistant", "h")]
    df = spark.createDataFrame([(m,)], f"m {M}")
    parts = df.select(messages.split_long(F.col("m"), lambda x: F.size(T.split_words(x)), 20).alias("p")).first()["p"]
    assert [len(p) for p in parts] == [2, 2]


def test_filters(spark):
    rows = [([("user", "x"), ("assistant", "I am called Claude and so on.")],), ([("assistant", None)],), ([("assistant", "fine.")],), (None,)]
    df = spark.createDataFrame(rows, f"m {M}")
    assert [r[0] for r in df.select(filters.tells_provider(F.col("m"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(filters.has_blank(F.col("m"))).collect()] == [False, True, False, False]
    assert len(filters.IDENTITY) == 17 and len(filters.PROVIDERS) == 15
    env = one(spark, filters.normalize_env(F.col("x")), '{"env_name": "g", "number": "7"}')
    assert env["env_configs"] == [{"env_name": "g", "number": "7"}]
    assert one(spark, filters.normalize_env(F.col("x")), '{"env_configs": [], "max_steps": 3}')["max_steps"] == 3
    assert one(spark, filters.normalize_env(F.col("x")), None)["env_configs"] is None
    with pytest.raises(ValueError):
        filters.guard_counts(90, 100)
    tagged = one(spark, filters.add_answer_tags(F.array(messages.message("assistant", F.col("x")))), "<think>a</think> b")
    assert tagged[0]["content"] == "<think>a</think> <answer>b</answer>"


def test_staleness(spark):
    got = spark.createDataFrame([(5,), (4,), (None,)], "s int").select(filters.not_stale(F.lit(7), F.col("s"), 2)).collect()
    assert [r[0] for r in got] == [True, False, True]


def decide(text, par=10, sent=40, cons=4):
    """The decision rule, block by block."""
    import re

    strip = str.strip

    def runs(items, least):
        places = {}
        for i, x in enumerate(items):
            if len(x) >= least:
                places.setdefault(x, []).append(i)
        out = {}
        for x, p in places.items():
            if len(p) > 1:
                best = run = 1
                for a, b in zip(p, p[1:]):
                    run = run + 1 if b == a + 1 else 1
                    best = max(best, run)
                out[x] = (len(p), best)
        return out

    for x, (n, c) in runs([strip(p) for p in text.split("\n\n") if strip(p)], 10).items():
        if not (c == 1 and len(x) < 20) and n >= (par if c > 1 else min(par * 2, 30)):
            return f"paragraph_repeated_{n}x"
    for x, (n, c) in runs([strip(p) for p in re.split(r"[.!?]+", text) if strip(p)], 5).items():
        if len(x.split()) > 1 and c >= cons:
            return f"line_repeated_{n}x_consecutive"
        if len(x.split()) > 1 and n >= sent and len(x) >= 10:
            return f"line_repeated_{n}x"
    return None


def test_repetition_decision(spark):
    a, b = "The model kept going round", "Clocks run fast"
    texts = [(a + ". ") * 6, (a + ". " + b + ". ") * 3, "\n\n".join([a] * 12), "\n\n".join([a, b] * 25), "plain text only", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r for r in repetition.repetition_decision(df, "k", "t").collect()}
    assert got[2]["reason"] == "paragraph_repeated_12x" and got[2]["repeated_block"] == a
    assert got[3]["reason"] == "paragraph_repeated_25x"
    assert not got[4]["has_repetition"] and not got[5]["has_repetition"] and len(got) == 7
    for k in (2, 3, 4):
        assert got[k]["reason"] == decide(texts[k])


def test_text_classes(spark):
    assert one(spark, repetition.is_math_or_code(F.col("x")), "x = y + 1") and one(spark, repetition.is_code_line(F.col("x")), "import numpy as np")
    assert one(spark, repetition.is_code_line(F.col("x")), "return True") and not one(spark, repetition.is_math_or_code(F.col("x")), "plain words")
    assert len(one(spark, T.paragraphs(F.col("x")), "Para 1.\n\nPara 2.\n\n\nPara 3.")) == 3
    assert len(one(spark, T.sentences(F.col("x")), "Sentence 1. Sentence 2! Sentence 3?")) == 3


def test_templates_and_masking(spark):
    m = [("system", "s"), ("user", "hi you"), ("assistant", "yo"), ("user", "go on"), ("assistant", "ok then")]
    df = spark.createDataFrame([(m,)], f"m {M}")
    assert df.select(tokenize.template("tagged", F.col("m"))).first()[0] == "<|system|>\ns\n<|user|>\nhi you\n<|assistant|>\nyo</s>\n<|user|>\ngo on\n<|assistant|>\nok then</s>"
    for name in tokenize.TEMPLATES:
        for generation in (False, True):
            assert df.select(tokenize.template(name, F.col("m"), generation=generation)).first()[0]
    with pytest.raises(ValueError):
        tokenize.template("nope", F.col("m"))
    full = df.select(tokenize.hashed_tokens(tokenize.template("tagged", F.col("m")))).first()[0]
    spans = df.select(tokenize.masked_spans(F.col("m")).alias("t")).first()["t"]
    assert spans["input_ids"] == full
    kept = [x for x in spans["labels"] if x != -100]
    yo = df.select(tokenize.hashed_tokens(F.lit("yo</s>"))).first()[0]
    end = df.select(tokenize.hashed_tokens(F.lit("ok then</s>"))).first()[0]
    assert kept == yo + end
    last = df.select(tokenize.masked_spans(F.col("m"), last_only=True).alias("t")).first()["t"]
    assert [x for x in last["labels"] if x != -100] == end
    sft = df.select(tokenize.sft(F.col("m"), mask_prompt=True).alias("t")).first()["t"]
    assert [x for x in sft["labels"] if x != -100] == sft["input_ids"][len(sft["prompt_ids"]) :]
    r = df.select(tokenize.verifiable(F.col("m"), F.lit("4"), F.lit("math")).alias("t")).first()["t"]
    assert r["ground_truth"] == ["4"] and r["prompt"].endswith("user: go on")
    cut = df.select(tokenize.truncate_messages(F.col("m"), 14).alias("t")).first()["t"]
    assert cut[0]["role"] == "system" and len(cut) < 5


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, "a,b C d e f"), (2, "a b x d e f"), (3, None), (4, "zz")], "k int, t string")
    items = spark.createDataFrame([(10, "A b c d"), (11, "zz"), (12, None), (13, "")], "q int, t string")
    assert sorted(map(tuple, decontam.exact_matches(docs, "k", "t", items, "q", "t").collect())) == [(1, 10), (4, 11)]
    s = decontam.ngram_scores(docs, "k", "t", items, "q", "t", 3).collect()
    assert [tuple(r) for r in s] == [(1, 10, 1.0)]


def test_preferences(spark):
    rows = [(1, "a", 3.0, 0), (1, "b", 3.0, 1), (1, "c", 1.0, 2), (1, "d", 1.0, 3), (2, "x", 2.0, 0), (3, "p", 1.0, 0), (3, "q", 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, r string, s double, o int")
    assert [(r["g"], r["chosen"], r["rejected"]) for r in preference.binarize(df, "g", "r", F.col("s"), "o").collect()] == [(1, "a", "d")]
    votes = spark.createDataFrame([(1, "A", 0), (1, "B", 1), (1, "B", 2), (2, "A", 0), (2, "B", 1)], "g int, v string, o int")
    won = {r["g"]: r["winner"] for r in preference.majority(votes, "g", "v", "o").collect()}
    assert won[1] == "B" and won[2] in "AB"
    r = preference.aspect_ratings(spark.createDataFrame([(1, "h", "4, x"), (1, "t", "2")], "g int, a string, r string"), "g", "a", "r").collect()
    assert {(x["place"], x["rating"]) for x in r} == {(0, 3.0), (1, -1.0)}


def test_gae_against_loop(spark):
    v, r, d = [0.5, 0.2, 0.9, 0.1], [1.0, 0.0, 2.0, 1.0], [0, 1, 0, 1]
    want, last, nxt = [0.0] * 4, 0.0, 0.0
    for t in reversed(range(4)):
        live = 1 - d[t]
        last = r[t] + 0.9 * nxt * live - v[t] + 0.9 * 0.8 * live * last
        want[t], nxt = last, v[t]
    df = spark.createDataFrame([(v, r, d)], "v array<double>, r array<double>, d array<int>")
    got = df.select(rl.gae(F.col("v"), F.col("r"), 0.9, 0.8, F.col("d"))).first()[0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_rl_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [-100, 5, 6], [True, False], [0, 1, 1])], "p array<double>, y array<int>, f array<boolean>, m array<int>")
    assert df.select(rl.sequence_logps(F.col("p"), F.col("y"))).first()[0] == 3.0
    assert df.select(rl.first_true(F.col("f"))).first()[0] == 0
    assert df.select(rl.masked_mean(F.col("p"), F.col("m"))).first()[0] == 2.5
    assert df.select(rl.pass_at_k(F.lit(4), F.lit(1), 2)).first()[0] == 0.5


def test_packing(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([4, 4, 3, 9, 1, 1])], "s int, o int, n int")
    got = [(r["o"], r["pack_id"]) for r in packing.pack_greedy(df, "s", "o", "n", 8).orderBy("o").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]
    ids = spark.createDataFrame([(1, 0, [5, 6], [5, 6]), (1, 1, [7], [7])], "b int, o int, i array<int>, l array<int>")
    c = packing.collate(ids, "b", "o", "i", "l").first()
    assert (c["input_ids"], c["labels"], c["position_ids"], c["seq_idx"], c["cu_seq_lens"]) == ([5, 6, 7], [-100, 6, -100], [0, 1, 0], [0, 0, 1], [0, 2, 3])
    assert packing.pad_batch(ids, "b", {"i": 0}).orderBy("o").collect()[1]["i"] == [7, 0]
    world = packing.strided_ranks(spark.range(10).withColumnRenamed("id", "i"), "i", 4, 10, drop_last=False)
    assert {r["count"] for r in world.groupBy("rank").count().collect()} == {3}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "é")], "id int, t string")
    io.write_jsonl(df, f"{tmp_path}/a.jsonl")
    assert sorted(map(tuple, io.read_any(spark, f"{tmp_path}/a.jsonl", "id int, t string").collect())) == [(1, "x"), (2, "é")]
    io.write_parquet(df, f"{tmp_path}/b")
    assert io.read_any(spark, f"{tmp_path}/b").count() == 2
    with pytest.raises(ValueError):
        io.read_any(spark, "x.jsonl", split="test")
    made = []
    make = lambda: (made.append(1), df)[1]
    for _ in range(2):
        assert io.cached(spark, str(tmp_path), {"a": 1}, make).count() == 2
    assert len(made) == 1 and io.config_hash({"a": 1}) != io.config_hash({"a": 2})
    assert [io.token_dtype(n) for n in (256, 257, 65536, 65537)] == ["uint8", "uint16", "uint16", "uint32"]
    tests = one(spark, io.decode_tests(io.encode_tests(F.col("x"))), '["a"]')
    assert json.loads(tests) == ["a"] and one(spark, io.decode_tests(F.col("x")), "gASVBQAAAA==") is None
    toks = spark.createDataFrame([(0, 0, [1, 2], [-100, 2]), (0, 1, [3], [3])], "s int, o int, i array<int>, l array<int>")
    r = io.export_tokens(toks, f"{tmp_path}/tok", "s", "o", "i", "l", 50257).collect()[0]
    assert (r["documents"], r["tokens"], r["trainable"]) == (2, 3, 2) and len(os.listdir(f"{tmp_path}/tok")) == 3
    assert "| id |" in io.markdown(df, "id")


def test_joins(spark):
    assert one(spark, joins.coerce(F.col("x"), "integer"), "7") == 7 and one(spark, joins.coerce(F.col("x"), "integer"), "q") is None
    with pytest.raises(Exception, match="no boolean"):
        one(spark, joins.coerce(F.col("x"), "boolean"), "maybe")
    calls = one(spark, joins.tool_calls(F.col("x"), ["code", "search"]), "a <search>q</search> <code>x</code> <other>z</other>")
    assert [tuple(c) for c in calls] == [("search", "q"), ("code", "x")]


def test_streams_equal_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = io.read_stream(spark, f"{tmp_path}/in", e.schema, files=2)
    groups = rollouts.complete_groups(stream, "user_id", "event_id", "value", 4)
    q = groups.writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select user_id, count(*) as n from groups group by user_id").collect()
    want = {r["user_id"]: r["count"] // 4 for r in e.groupBy("user_id").count().collect()}
    assert {r["user_id"]: r["n"] for r in got} == {k: v for k, v in want.items() if v}
    rollouts.write_rollouts(io.read_stream(spark, f"{tmp_path}/in", e.schema), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == e.count()
    rubrics = rollouts.rubric_buffer(io.read_stream(spark, f"{tmp_path}/in", e.schema), "event_type", "props", "value", 3)
    q = rubrics.writeStream.format("memory").queryName("rubrics").outputMode("update").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select max(size(rubrics)) from rubrics").first()[0] == 3


def test_registry(spark):
    m = [("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame([(i, m) for i in range(10)], f"row_id int, messages {M}")
    out = registry.mixture([registry.Source("a", df, "row_id", 1.0, [("sft_tokenize", {}), ("sft_filter", {})]), registry.Source("b", df, "row_id", 3, [("sft_tokenize", {})])])
    assert out.count() == 13 and sorted(r["index"] for r in out.collect()) == list(range(13))
    rows = df.select("row_id", F.lit("<answer>4</answer>").alias("x"), F.array(F.lit("4"), F.lit("4")).alias("t"), F.array(F.lit("String_Matcher"), F.lit("nope")).alias("v"))
    assert {r["reward"] for r in V.apply_verifiers(rows, "x", "t", "v").collect()} == {1.0}
