"""Edits at an item's first and last words, against brute force; angle brackets that are no tags."""

import random

from mixloom.llm import leaks
from tests.llm.test_leaks import ITEMS, TRAIN, WORDS, distance


def test_every_pair_of_distance_two_is_found(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.sample(WORDS, 12)), "x", None) for i in range(8)]
    train = []
    for r in range(160):
        part = items[rng.randrange(8)][1].split()
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            k = rng.choice([0, len(part) - 1, rng.randrange(len(part))])
            part[k : k + rng.choice([0, 1, 1])] = rng.choice([[], ["zzchanged"]])
        train.append((1000 + r, [("user", " ".join(rng.sample(WORDS, 8) + part + rng.sample(WORDS, 8)))], None, None))
    got = {tuple(x) for x in leaks.find_leaks(spark.createDataFrame(train, TRAIN), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(i, key) for key, m, _, _ in train for i, s, _, _ in items if distance(s.split(), m[0][1].split()) <= 2}
    assert got == want and len(want) > 60


def test_words_in_angle_brackets_stay():
    assert "some words here" in leaks._plain("x <<some words here>> y") and "< 5 and 7 >" in leaks._plain("a < 5 and 7 > b")
    assert "br" not in leaks._plain("a<br/>b</br><!-- c -->")
