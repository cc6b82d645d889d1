import pytest

from mixloom.llm.sentences import sentence_units, split_text

CASES = [
    ("The run ended. It was late.", ["The run ended.", "It was late."]),
    ("It cost 3.50 dollars in v2.1.0 of a.b.py. Fine!", ["It cost 3.50 dollars in v2.1.0 of a.b.py.", "Fine!"]),
    ("Dr. Smith met Mr. B. Jones at 5 p.m. today. They left.", ["Dr. Smith met Mr. B. Jones at 5 p.m. today.", "They left."]),
    ('He said "Stop! It fell." and left. Then?', ['He said "Stop! It fell." and left.', "Then?"]),
    ('The card says: "Use it once. Not twice." The rest is fine.', ['The card says: "Use it once. Not twice."', "The rest is fine."]),
    ("(See the note. It is long.) Then go.", ["(See the note. It is long.)", "Then go."]),
    ("See Fig. 4 and No. 7. Next.", ["See Fig. 4 and No. 7.", "Next."]),
    ("a wrapped\nline goes on. Next\none.", ["a wrapped\nline goes on.", "Next\none."]),
    ("No mark here\n\nNext paragraph", ["No mark here", "Next paragraph"]),
    ("# A title. With stop\nText one. Text two.", ["# A title. With stop", "Text one.", "Text two."]),
    ("- item one. More of it.\n- item two\n\nAfter.", ["- item one. More of it.", "- item two", "After."]),
    ("```py\nx = 1.\n\ny = 2.\n```\nDone.", ["```py\nx = 1.\n\ny = 2.\n```", "Done."]),
    ("User: Hello there. How are you?\nAssistant: Fine.", ["User: Hello there.", "How are you?", "Assistant: Fine."]),
    ("什么都没有变。“太慢了！真的。”小明说。好吗？", ["什么都没有变。", "“太慢了！真的。”小明说。", "好吗？"]),
    ("说明には「一度だけ。混ぜない。」と書いてある。次。", ["说明には「一度だけ。混ぜない。」と書いてある。", "次。"]),
    ("क्या यह है? हाँ। डॉ. Smith आए।", ["क्या यह है?", "हाँ।", "डॉ. Smith आए।"]),
    ("هل هذا جيد؟ نعم. قال د. Smith ذلك.", ["هل هذا جيد؟", "نعم.", "قال د. Smith ذلك."]),
    ("ไม่มีอะไรเปลี่ยน ค่าเพิ่มจาก 4.5 เป็น 6 ในรอบนี้ ดี", ["ไม่มีอะไรเปลี่ยน", "ค่าเพิ่มจาก 4.5 เป็น 6 ในรอบนี้", "ดี"]),
    ("Am 5. Juni kam er, z. B. mit Dr. Weiß. Es war spät.", ["Am 5. Juni kam er, z. B. mit Dr. Weiß.", "Es war spät."]),
    ("It goes on ... and then stops. Yes.", ["It goes on ... and then stops.", "Yes."]),
    ("the token dropped.Then it rose.", ["the token dropped.", "Then it rose."]),
    ("¿Qué pasa? ¡Nada! Fin.", ["¿Qué pasa?", "¡Nada!", "Fin."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_rules(text, want):
    assert [text[a:b] for a, b in split_text(text)] == want


def test_units_cover_everything(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    units: dict = {}
    for r in sentence_units(d).collect():
        units.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    for r in d.collect():
        text, got = r["text"] or "", sorted(units.get(r["doc_id"], []))
        assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        covered = set()
        for a, b in got:
            assert not text[a].isspace() and not text[b - 1].isspace()
            covered.update(range(a, b))
        assert all(c.isspace() or i in covered for i, c in enumerate(text)), r["doc_id"]


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (4, "One. Two.", 0), (4, "One. Two.", 0), (None, "x", 0), (5, "word. " * 20_000, 0), (6, "```\nopen", 0), (7, '"' * 50 + "(((", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_char int")
    got = [tuple(r) for r in sentence_units(df).collect()]
    assert sorted(x for x in got if x[0] == 4) == [(4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9)]
    assert not [x for x in got if x[0] in (1, 2, 3)] and (None, 0, 1) in got
    assert sentence_units(df.limit(0)).collect() == []


def test_the_document_tells_its_abbreviations():
    text = "The appx. value is low, and appx. others too. We saw the appx. It fell."
    assert len(split_text(text)) >= 2
    assert not any(text[a:b].startswith("value") for a, b in split_text(text))
