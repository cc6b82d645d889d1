"""Fitted models are saved and reused; list items others go on after are counted over all responses."""

import re

from mixloom.llm import defects
from mixloom.llm.refusals import PARTS, refusals
from tests.llm.test_defects_whole import PROMPT, model  # noqa: F401

C = "gen_id bigint, text string, outputs array<struct<text:string,finish_reason:string>>, last string, followed string"


def completions(spark):
    texts = ["Steps:\n- open the file\n- read the table", "Do:\n- read the table\n- close it", "So:\n* read the table\r\n* stop 3 runs", "- read the table\n- end", "1. stop 7 runs\nDone.", "- stop 9 runs\nDone.", None, ""]
    return spark.createDataFrame([(i, "q", [(t, None)], None, None) for i, t in enumerate(texts)] + [(None, "q", [("x", None)], None, None), (50, None, None, None, None)], C)


def test_followed_items_by_brute_force(spark):
    df = completions(spark)
    entries = defects.entries_of(df)
    flagged = defects.with_followed(entries, defects.followed_items(entries))
    got = {r["gen_id"] for r in flagged.collect() if any(k is not None and k in (r["followed"] or ()) for k in r["last"])}
    seen: dict = {}
    key = lambda line: re.sub(r"\d+", "0", re.sub(r"^\s*(?:[-*•+]|\d+[.)])\s+", "", line)).strip().lower()
    item = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+\S")
    rows = [(r["gen_id"], o["text"]) for r in df.where("gen_id is not null and outputs is not null").collect() for o in r["outputs"] if o["text"]]
    for _, t in rows:
        for line in t.rstrip().splitlines()[:-1]:
            if item.match(line):
                seen[key(line)] = seen.get(key(line), 0) + 1
    assert got == {i for i, t in rows if item.match(t.splitlines()[-1]) and seen.get(key(t.splitlines()[-1]), 0) > 1} == {0, 2}


def test_saved_models_classify_alike(spark, tmp_path, model):  # noqa: F811
    path = f"file://{tmp_path}/model"
    defects.save(model, spark, path)
    again = defects.load(spark, path)
    pairs = [(PROMPT, t) for t in (PROMPT, "", None, "I'm sorry, but I can't help with that.", "The loss went down because the", "The loss went down after the second run.")]
    assert defects.classify(*again, pairs) == defects.classify(*model, pairs)
    found = defects.find_defects(completions(spark), spark.createDataFrame([], "row_id bigint, lang string, messages array<struct<role:string,content:string>>"), again)
    assert {(r["gen_id"], r["output_no"]): r["defect"] for r in found.collect()}[6, 0] == "empty"


def test_refusals_with_clauses_never_trained_on(model):  # noqa: F811
    import numpy as np

    features, models = model
    kept = {k: (v[0], v[1][1::2], v[2], v[3], v[4]) for k, v in PARTS.items()}
    before = dict(PARTS)
    try:
        PARTS.update({k: (v[0], v[1][::2], v[2], v[3], v[4]) for k, v in before.items()})
        trained = refusals(np.random.default_rng(1), 1500)
        PARTS.update(kept)
        held = refusals(np.random.default_rng(2), 300)
    finally:
        PARTS.update(before)
    rng = np.random.default_rng(3)
    words = "the loss curve fell after a run because every token mask was checked and we kept two seeds for it".split()
    normal = [" ".join(rng.choice(words, 14)) + "." for _ in range(1500)]
    rows = [features.one("refusal", PROMPT, t) for t in trained + normal]
    y = np.array([1.0] * len(trained) + [0.0] * len(normal))
    fitted = defects.Linear().fit(rows, y, np.ones(len(y)), 1)
    recall = (fitted.probabilities([features.one("refusal", PROMPT, t) for t in held]) > 0.5).mean()
    assert recall > 0.9
