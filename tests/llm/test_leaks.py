import random

from mixloom.llm import leaks

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
TRAIN = "row_id bigint, messages array<struct<role:string,content:string>>, item_id string, text string"
ITEMS = "item_id bigint, text string, row_id string, lang string"


def distance(window, text):
    """Least edits of a window against any part of a text (brute force)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_equals_brute_force_with_edits(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.sample(WORDS, 24)), "x", None) for i in range(12)]
    train, want = [], set()
    for r in range(160):
        words = items[rng.randrange(12)][1].split()
        n = rng.choice([6, 8, 14, 16, 20])
        at = rng.randrange(len(words) - n + 1)
        part = words[at : at + n]
        for _ in range(rng.choice([0, 1, 2, 2, 5])):
            k = rng.randrange(1, max(2, len(part) - 1))
            how = rng.random()
            if how < 0.34:
                part[k : k + 1] = []
            elif how < 0.67:
                part[k : k + 1] = ["zzchanged"]
            else:
                part[k:k] = ["zzadded"]
        text = rng.sample(WORDS, 10) + part + rng.sample(WORDS, 10)
        train.append((1000 + r, [("user", " ".join(text)), ("assistant", None)], None, None))
    got = {tuple(x) for x in leaks.find_leaks(spark.createDataFrame(train, TRAIN), spark.createDataFrame(items, ITEMS)).collect()}
    for key, messages, _, _ in train:
        text = messages[0][1].split()
        for item, s, _, _ in items:
            w = s.split()
            # A run that begins and ends with a match: at most two edits over at least 12 words.
            best = min(distance(w[i : i + 12], text) for i in range(len(w) - 11))
            if best == 0:
                want.add((item, key))
            if (item, key) in got:
                assert best <= 2
    assert want <= got and len(got) > len(want)


def test_forms_that_do_not_count_as_changes(spark):
    item = "A copper barge named Jasmund leaves Eastelhaven with 18,689 frobdle, drops 50 at Eastelholm, loads 27 pluddle"
    zh = "9日早上帕沃从伊林威克运来八十八箱采样循环零件，其中十箱交给韦克斯，剩下的全部卖给马拉"
    same = [
        item.upper(), item.replace(" ", " \n "), "".join(f"<b>{w}</b> " for w in item.split()), item.replace(",", "").replace(" ", "&nbsp;"), "**" + item.replace(" ", "** **") + "**",
        item.replace("o", "o​"), item.replace("1", "１").replace(",", "，"), '{"q": "' + item.replace(" drops", '\\" drops') + '"}', "x " + zh[3:30] + " y", zh.replace("，", " , "),
    ]
    other = [item[:40], zh[:15], item.replace("copper", "tin").replace("Jasmund", "Velin").replace("Eastelhaven", "Illmere").replace("frobdle", "x").replace("Eastelholm", "y").replace("pluddle", "z"), "", " "]
    rows = [(100 + i, [("user", t)], None, None) for i, t in enumerate(same + other)]
    rows += [(200, None, None, None), (201, [], None, None), (202, [None], None, None), (None, [("user", item)], None, None), rows[0]]
    items = [(1, item, "x", None), (2, zh, None, "zh"), (3, "too short", None, None), (4, None, None, None), (None, item, None, None)]
    got = sorted(tuple(x) for x in leaks.find_leaks(spark.createDataFrame(rows, TRAIN), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(1, 100 + i) for i in range(8)] + [(2, 108), (2, 109)]


def test_a_passage_must_lie_in_one_message(spark):
    words = WORDS[:20]
    rows = [(9, [("user", " ".join(words[:9])), ("assistant", " ".join(words[9:18]))], None, None)]
    assert leaks.find_leaks(spark.createDataFrame(rows, TRAIN), spark.createDataFrame([(1, " ".join(words), None, None)], ITEMS)).collect() == []


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, " ".join(WORDS[:20]), None, None)], ITEMS)
    train = spark.createDataFrame([(1, [("user", "x " * 30)], None, None)], TRAIN)
    for a, b in ((train.limit(0), items), (train, items.limit(0))):
        assert leaks.find_leaks(a, b).collect() == []


def test_bitmap_has_no_false_negatives(spark):
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    b = leaks.Bitmap.of(spark.createDataFrame([(int(x),) for x in h], "hash bigint"))
    assert b.has(h).all() and b.has(h + 1).mean() < 0.02


def test_passages_anywhere_in_long_messages(spark):
    rng = random.Random(9)
    item = WORDS[:30]
    rows = []
    for at in range(0, 230):
        part = item[at % 15 : at % 15 + 14]
        part[3 + at % 8] = "zzchanged"
        rows.append((at + 100, [("user", " ".join([rng.choice(WORDS[40:]) for _ in range(at)] + part + [rng.choice(WORDS[40:]) for _ in range(200)]))], None, None))
    items = spark.createDataFrame([(1, " ".join(item), None, None)], ITEMS)
    assert {r["row_id"] for r in leaks.find_leaks(spark.createDataFrame(rows, TRAIN), items).collect()} == {r[0] for r in rows}


def test_repetitive_texts(spark):
    rows = [(100, [("user", "la " * 3000)], None, None), (101, [("user", " ".join(WORDS[:11] * 300))], None, None), (102, [("user", " ".join(WORDS[:12] * 300))], None, None)]
    items = [(1, "la " * 200, None, None), (2, " ".join(WORDS[:12]), None, None)]
    got = {tuple(x) for x in leaks.find_leaks(spark.createDataFrame(rows, TRAIN), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, 100), (2, 101), (2, 102)}


def test_long_markup_and_unspaced_scripts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    link = '<a href="' + "very/long/address/" * 20 + '" title="x y">'
    thai = "ภาษาไทยไม่มีช่องว่างระหว่างคำในประโยคยาวๆแบบนี้"
    rows = [(100, [("user", item.replace("seven", link + "seven</a>"))], None, None), (101, [("user", "ก่อน" + thai[:25] + "หลัง")], None, None)]
    items = [(1, item, None, None), (2, thai, None, "th")]
    got = sorted(tuple(x) for x in leaks.find_leaks(spark.createDataFrame(rows, TRAIN), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(1, 100), (2, 101)]
