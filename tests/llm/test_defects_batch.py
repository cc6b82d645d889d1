"""A batch's features are computed at once and are those of its pairs one by one."""

import random

import numpy as np
import pytest

from mixloom.llm import defects
from tests.llm.test_defects import SENTENCES, corpus


@pytest.fixture(scope="module")
def features():
    rows = corpus(200, 3)
    return defects.Features(defects.Languages([(x, lang) for _, t, lang in rows for x in t]), frozenset("the loss went down".split()))


def pairs():
    rng = random.Random(4)
    odd = "\n \t.。!?()[]{}<>`\"'-*•1²٣é“”«»「」\u200b\x00\ud800ก中かनa_B,;:፩İ’"
    made = [(p, t) for p, ts, _ in corpus(150, 5) for t in ts]
    made += [(p, t[: rng.randint(0, len(t))] + "".join(rng.choices(odd, k=4))) for p, t in made]
    made += [("".join(rng.choices(odd, k=rng.randint(0, 20))), "".join(rng.choices(odd, k=rng.randint(0, 90)))) for _ in range(600)]
    made += [(p, "\n".join(f"- {t}" for _ in range(rng.randint(1, 9)))) for p, t in made[:100]]
    return made + [(None, None), ("", ""), ("x", None), (None, "one two"), ("x", "<think>no</think>Ja. `the loss` went")]


def test_a_batch_gives_the_features_of_each_pair(features):
    rows = pairs()
    flags = [i % 3 == 0 for i in range(len(rows))]
    packed = features.many(rows, flags)
    for i, ((p, t), x) in enumerate(zip(rows, flags)):
        for d, slots in features.of(p, t, x).items():
            flat, ends = packed[d]
            assert np.array_equal(flat[ends[i] : ends[i + 1]], slots), (d, p, t)
    assert all(len(ends) == 1 and not len(flat) for flat, ends in features.many([]).values())


def test_shares_of_many_texts(features):
    texts = [t or "" for _, t in pairs()] + [". ".join(SENTENCES["en"]) + ".\n" + ". ".join(SENTENCES["de"]), "\x00", "\n\n"]
    many = features.languages.shares_many(texts)
    assert many == [features.languages.shares(t) for t in texts] and {"en", "de"} <= set(many[-3][0])
    assert defects.Languages([]).shares_many(texts[:50]) == [defects.Languages([]).shares(t) for t in texts[:50]]


def test_latin_texts_are_not_looked_at_one_by_one(features, monkeypatch):
    models = {d: defects.Linear() for d in defects.DEFECTS}
    rows = [(p, t) for p, ts, lang in corpus(100, 6) for t in ts if lang != "zh"]
    calls = []
    monkeypatch.setattr(defects.Languages, "shares", lambda self, text: calls.append(text))
    assert len(defects.classify(features, models, rows)) == len(rows) > 100 and not calls
