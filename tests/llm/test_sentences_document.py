"""What a document tells by itself comes before the corpus, whatever the size of the corpus."""

import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from mixloom.llm.sentences import COUNTS, Evidence, asked_words, observe, sentence_units, settle, split_text


def evidence(**words):
    """Counts by word: d, n, c, g, e, m, s."""
    return Evidence({w: tuple(c.get(k, 0) for k in COUNTS) for w, c in words.items()})


def units(text, known=None):
    return [text[a:b] for a, b in (split_text(text, known) if known else split_text(text))]


def test_the_document_comes_before_the_corpus():
    text = "The approxim. value is low. We saw the approxim. Xenolith there."
    often = evidence(approxim=dict(n=500), xenolith=dict(n=1), Xenolith=dict(m=9))
    assert units(text, often) == ["The approxim. value is low.", "We saw the approxim. Xenolith there."]
    told = evidence(dept=dict(d=50, c=30), Rowan=dict(n=9, m=9))
    assert units("We asked the dept about it. It was our dept. Rowan came.", told) == ["We asked the dept about it.", "It was our dept.", "Rowan came."]
    assert units("It was our dept. Rowan came.", told) == ["It was our dept. Rowan came."]


def test_the_document_overrules_the_lists():
    assert units("He met the Gen. Rowan came.") == ["He met the Gen. Rowan came."]
    assert units("A Gen is a unit here. He met the Gen. Rowan came.") == ["A Gen is a unit here.", "He met the Gen.", "Rowan came."]


def test_the_corpus_overrules_the_lists():
    ordinary = evidence(Gen=dict(d=20, n=300, e=5))
    assert units("He met the Gen. Rowan came.", ordinary) == ["He met the Gen.", "Rowan came."]
    ends = evidence(Gen=dict(d=90, c=40, e=20), Rowan=dict(n=9, s=9))
    assert units("He met the Gen. Rowan came.", ends) == ["He met the Gen.", "Rowan came."]


def test_the_document_tells_its_names():
    ordinary = evidence(stone=dict(n=90), Stone=dict(n=10, m=1, s=9))
    assert units("We met B. Stone there.", ordinary) == ["We met B.", "Stone there."]
    assert units("Then we saw Stone again. We met B. Stone there.", ordinary) == ["Then we saw Stone again.", "We met B. Stone there."]


def test_a_tenfold_corpus_splits_alike():
    text = "We saw appx. values. The appx. Delta fell. On the 3. Delta rose. It was etc. Gamma rose."
    counts = dict(Gamma=dict(s=2, m=4, n=7), Delta=dict(m=3, n=4), appx=dict(d=3, c=2))
    splits = [units(text, evidence(**{w: {k: n * f for k, n in c.items()} for w, c in counts.items()})) for f in (1, 10, 1000)]
    assert splits[0] == splits[1] == splits[2]


def test_words_inside_unspaced_runs_are_counted():
    text = "我们的dept.在这里工作了很多年而且没有任何问题因为大家都很努力地完成自己的任务并且互相帮助所以一切都很顺利，见dept.里，" + "字" * 500
    counts, tokens = Counter(), Counter()
    observe(text, counts, tokens)
    settle(tokens, counts)
    assert counts["d", "dept"] == 2


class Recorder(Evidence):
    asked: set

    def of(self, word):
        self.asked.add(word)
        return super().of(word)


@pytest.mark.parametrize("known", [{}, {"etc": (50, 0, 20, 0, 9, 0, 0), "Dr": (90, 0, 0, 0, 0, 0, 0), "The": (0, 90, 0, 0, 0, 2, 40)}])
def test_every_word_that_is_asked_for_is_foreseen(known, sf):
    for text in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist():
        recorder = Recorder(known)
        recorder.asked = set()
        split_text(text, recorder)
        assert recorder.asked <= asked_words(text or ""), text


def test_joined_counts_split_like_broadcast_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, sentence_units(docs).collect()))
    assert whole and whole == sorted(map(tuple, sentence_units(docs, hot=20).collect()))


@pytest.mark.parametrize("text", ["([{" * 350_000, '"a ( ' * 250_000, "A.A.A." * 170_000, "x!" * 500_000, "12. May " * 130_000, "ไทย ไทย (" * 100_000], ids=range(6))
def test_megabytes_of_marks_are_linear(text):
    began = time.process_time()
    split_text(text)
    asked_words(text)
    assert time.process_time() - began < 15
