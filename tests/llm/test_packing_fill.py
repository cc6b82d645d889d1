"""Containers are filled as by the plain rule, while placed items leave the index."""

import numpy as np

from mixloom.llm import packing
from mixloom.llm.packing import CLOSING, SLACK


def items(n, seed, vocabulary=300):
    rng = np.random.default_rng(seed)
    terms = [np.unique(rng.zipf(1.3, rng.integers(1, 40)) % vocabulary).astype(np.int32) for _ in range(n)]
    counts = [rng.integers(1, 9, len(t)).astype(np.int32) for t in terms]
    return np.array([int(c.sum()) for c in counts]), terms, counts


def plainly(sizes, terms, counts, capacity):
    """The rule, seed by seed over all items, with the index of all items."""
    index = packing.Bm25(terms, counts)
    unused, made = sizes > 0, []
    for seed in np.argsort(-sizes, kind="stable"):
        if not unused[seed]:
            continue
        scores, room = index.scores([terms[seed]])[0], capacity - sizes[seed]
        unused[seed], container = False, [int(seed)]
        while len(fits := np.flatnonzero(unused & (sizes <= room))):
            left = room - sizes[fits]
            closing = fits[left <= SLACK * capacity]
            best = fits[np.argmax(scores[fits])]
            rest = room - sizes[best]
            last = SLACK * capacity < rest <= CLOSING * capacity and len(closing) and (unused & (sizes <= rest)).sum() <= 1
            if room <= CLOSING * capacity:
                best = closing[np.argmax(scores[closing])] if len(closing) else fits[np.argmin(left)]
            elif last:
                best = closing[np.argmax(scores[closing])]
            unused[best] = False
            container.append(int(best))
            room -= sizes[best]
        made.append(container)
    return made


def by_size(sizes, terms, counts):
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], [terms[i] for i in order], [counts[i] for i in order]


def test_filled_as_by_the_plain_rule():
    for n, seed, capacity in ((1, 1, 300), (700, 2, 400), (900, 3, 250)):
        sizes, terms, counts = by_size(*items(n, seed))
        assert packing.fill(sizes, terms, counts, capacity) == plainly(sizes, terms, counts, capacity)


def test_items_of_any_order_and_without_tokens():
    sizes, terms, counts = items(400, 5)
    sizes, terms, counts = np.append(sizes, [0, 0]), [*terms, *[np.empty(0, np.int32)] * 2], [*counts, *[np.empty(0, np.int32)] * 2]
    made = packing.fill(sizes, terms, counts, 300)
    assert sorted(i for c in made for i in c) == list(range(402)) and {400, 401} <= set(made[0])
    assert max(sizes[c].sum() for c in made) <= 300
    assert packing.fill(sizes[400:], terms[400:], counts[400:], 300) == [[0, 1]]


def test_a_smaller_index_gives_the_scores_of_its_items():
    sizes, terms, counts = items(500, 7)
    index = packing.Bm25(terms, counts)
    kept = np.random.default_rng(1).random(500) < 0.6
    before = index.scores(terms[:20])
    index.keep(kept)
    assert np.allclose(index.scores(terms[:20]), before[:, kept], rtol=1e-5) and len(index.doc) < sum(map(len, terms))
    index.keep(np.zeros(int(kept.sum()), bool))
    assert index.scores(terms[:2]).shape == (2, 0)


def test_later_seeds_are_scored_against_what_is_left(monkeypatch):
    sizes, terms, counts = items(3000, 9)
    seen = []
    often = packing.Bm25.often
    monkeypatch.setattr(packing.Bm25, "often", lambda self, queries: seen.append((len(queries), self.n)) or often(self, queries))
    packing.fill(sizes, terms, counts, 400)
    # Scores asked for, as a share of all items for each seed.
    assert sum(q * n for q, n in seen) < 0.7 * 3000 * sum(q for q, _ in seen)
