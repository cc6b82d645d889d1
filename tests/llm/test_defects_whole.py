"""Features look at every entry and at its whole text."""

import random

import numpy as np
import pytest

from mixloom.llm import defects
from tests.llm.test_defects import SENTENCES, corpus

PROMPT = "Explain why the loss of run 5 went down after the change?"


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    rows = corpus(300, 1)
    sample = [(p, t) for p, t, _ in rows]
    for i in range(300):
        steps = rng.sample(SENTENCES["en"], rng.randint(3, 4))
        sample.append((f"Give the steps of run {i}", ["Here they are.\n" + "\n".join(f"{k}. {x}." for k, x in enumerate(steps, 1)) for _ in range(2)]))
    return defects.train(sample, [(x, lang) for _, t, lang in rows for x in t])


def test_a_repeated_prompt_is_a_copy(model):
    for text in ("\n".join([PROMPT] * 5), " ".join([PROMPT] * 6)):
        assert defects.classify(*model, [(PROMPT, text)]) == ["copy"]


def test_a_list_that_breaks_off_after_its_number(model):
    head = "Here they are.\n1. Open the file and look at the first lines.\n2. We kept most of the rows and dropped the rest.\n3."
    assert defects.classify(*model, [(PROMPT, head)]) == ["truncated"]
    assert defects.classify(*model, [(PROMPT, head + " The loss went down after the second run.")]) == [None]


def test_a_smaller_language_is_seen(model):
    text = ". ".join(SENTENCES["en"][:4]) + ". " + SENTENCES["de"][0] + "."
    found, n = model[0].languages.shares(text)
    assert set(found) == {"en", "de"} and sum(found.values()) == n


def test_features_reach_back_over_the_whole_text(model):
    words = "and it goes on " * 60
    plain, opened = "So " + words + "here", "So (" + words + "here"
    of = lambda text: set(model[0].of(PROMPT, text)["truncated"].tolist())
    assert of(plain) != of(opened)
    assert defects._last_sentence("One. Two " + words) == "Two " + words
    assert of(plain + ".") != of(opened + ".")


def test_made_cuts_after_stops():
    rng = np.random.default_rng(1)
    text = "We went to see what the good Dr. Lang wrote about it\n1. Open the file\n2. Look at 3.5 of them\n3. Close the file again"
    made = {defects._cut(text, rng) for _ in range(400)} - {None}
    assert any(x.endswith("\n3.") for x in made) and any(x.endswith("Dr.") for x in made) and any(x.endswith(" 3.") for x in made)
