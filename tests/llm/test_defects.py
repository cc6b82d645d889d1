import random

import numpy as np
import pytest

from mixloom.llm import defects
from mixloom.llm.refusals import refusals

SENTENCES = {
    "en": ["The loss went down after the second run", "We kept most of the rows and dropped the rest", "A smaller model is often good enough for this", "You should check the labels before the next step", "Open the file and look at the first lines"],
    "de": ["Der Wert ist nach dem zweiten Lauf gefallen", "Wir haben die meisten Zeilen behalten und den Rest verworfen", "Ein kleines Modell ist oft gut genug", "Bitte prüfen Sie die Marken vor dem nächsten Schritt"],
    "zh": ["第二次运行之后损失下降了", "我们保留了大部分数据并删除了其余的", "小模型通常已经足够好了", "请在下一步之前检查标签"],
}
PROMPTS = {"en": "Explain why the loss of run {} went down after the change", "de": "Warum ist der Wert im Lauf {} nach der Änderung gefallen", "zh": "为什么第{}次运行之后损失会下降"}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "zh"])
        end = "。" if lang == "zh" else ". "
        texts = [end.join(rng.sample(SENTENCES[lang], rng.randint(2, 4))) + end.strip() for _ in range(2)]
        out.append((PROMPTS[lang].format(i) + ("？" if lang == "zh" else "?"), texts, lang))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(400, 1)
    return defects.train([(p, t) for p, t, _ in rows], [(x, lang) for _, t, lang in rows for x in t])


def test_held_out_accuracy(model):
    features, models = model
    rng = np.random.default_rng(9)
    rows = corpus(150, 2)
    by = {k: [t for _, ts, lang in rows if lang == k for t in ts] for k in SENTENCES}
    cases = []
    for p, ts, lang in rows:
        cases.append((p, ts[0], None))
        cases.append((p, p.lower(), "copy"))
        cases.append((p, by["de" if lang != "de" else "en"][0], "language"))
        if (c := defects._cut(ts[1], rng)) and len(c) > 20:
            cases.append((p, c, "truncated"))
    cases += [(rows[0][0], t, "refusal") for t in refusals(np.random.default_rng(77), 200)]
    found = defects.classify(features, models, [(p, t) for p, t, _ in cases])
    for d in (None, "copy", "language", "truncated", "refusal"):
        mine = [f for f, c in zip(found, cases) if c[2] == d]
        assert np.mean([f == d for f in mine]) > 0.85, (d, {x: mine.count(x) for x in set(mine)})


def test_empty_and_short_answers(model):
    features, models = model
    p = "What is 3 + 4 in the run?"
    for t in (None, "", " ", "​", "...", "Answer:", "<answer></answer>", "N/A", "[no response]", "```\n```", "-"):
        assert defects.classify(features, models, [(p, t)]) == ["empty"], repr(t)
    for t in ("7", "No.", "(A)", "Yes", "The answer is 7"):
        assert defects.classify(features, models, [(p, t)]) == [None], repr(t)


def test_asked_for_language_and_copy(model):
    features, models = model
    en = ". ".join(SENTENCES["en"][:3]) + "."
    de = ". ".join(SENTENCES["de"][:3]) + "."
    assert defects.classify(features, models, [("Explain why the loss went down after the change?", de)]) == ["language"]
    assert defects.classify(features, models, [("Answer in German, please: Explain why the loss went down after the change?", de)]) == [None]
    assert defects.classify(features, models, [("Explain why the loss went down after the change?", en)]) == [None]


def test_query_edge_cases(spark):
    out = "array<struct<text:string,finish_reason:string>>"
    rows = [(i, p, [(t, None) for t in ts]) for i, (p, ts, _) in enumerate(corpus(120, 5))]
    rows += [(500, "Explain the loss", [None, ("", "stop"), ("Fine then, it fell.", "length")]), (501, "x", None), (502, "x", []), (503, None, [(None, None)]), (None, "x", [("", None)]), (500, "Explain the loss", [None, ("", "stop"), ("Fine then, it fell.", "length")])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"gen_id bigint, text string, outputs {out}, defect string")
    labelled = spark.createDataFrame([(i, lang, [("user", t[0])]) for i, (_, t, lang) in enumerate(corpus(100, 6))], "row_id bigint, lang string, messages array<struct<role:string,content:string>>")
    got = [tuple(r) for r in defects.find_defects(df, labelled).collect()]
    assert {(500, 0, "empty"), (500, 1, "empty"), (503, 0, "empty")} <= set(got)
    assert len(got) == len({g[:2] for g in got}) and not [g for g in got if g[0] in (501, 502, None)]
    assert defects.find_defects(df.limit(0), labelled.limit(0)).collect() == []
