import numpy as np

from mixloom.llm import mixing

ROWS = "row_id bigint, dataset string, mix string, copies bigint"
SPEC = "mix string, dataset string, target_share double, max_repeats int"


def test_pivotal_keeps_the_sum_and_rounds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 500):
        p = rng.random(n)
        out = mixing.pivotal(p, rng)
        assert abs(out.sum() - p.sum()) < 1e-6
        assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 1


def test_pivotal_keeps_inclusion_probabilities():
    p = np.array([0.2, 0.5, 0.9, 0.4, 0.7, 0.3])
    mean = np.mean([mixing.pivotal(p, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def rows_of(spark):
    rows = [(i, "big", None, None) for i in range(1000)] + [(1000 + i, " Own/Small-Set ", None, None) for i in range(50)] + [(5, "BIG", None, None), (2000, None, None, None), (None, "big", None, None)]
    spec = [("m", "big", 0.7, 2), ("m", "small_set", 0.2, 3), ("m", "absent", 0.1, 5), ("n", "big", 1.0, 1), ("o", "absent", 1.0, 1), (None, "big", None, None)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(spec, SPEC)


def test_shares_and_caps(spark):
    rows, spec = rows_of(spark)
    plan, copies = mixing.mix_copies(rows, spec, leaf=100, fan=3)
    got = {(r["mix"], r["dataset"]): r for r in mixing.mix_shares(plan, copies).collect()}
    assert len(got) == 6
    big, small, absent = got["m", "big"], got["m", "small_set"], got["m", "absent"]
    assert big["examples"] == 1000 and small["examples"] == 50 and absent["examples"] == 0 and big["total"] == 1050
    assert abs(big["copies"] - 735) <= 1 and big["most_repeats"] <= 2 and not big["short"]
    assert small["copies"] == 150 and small["short"] and absent["short"] and absent["copies"] == 0
    assert got["n", "big"]["copies"] == 1000 and got["o", "absent"]["actual_share"] is None and not got["o", "absent"]["short"]
    found = {(r["mix"], r["dataset"]) for r in mixing.short_sources(mixing.mix_shares(plan, copies)).collect()}
    assert found == {("m", "small_set"), ("m", "absent")}


def test_outcome_does_not_depend_on_partitions(spark):
    rows, spec = rows_of(spark)
    a = sorted(map(tuple, mixing.mix_copies(rows, spec, leaf=100, fan=3)[1].collect()), key=repr)
    b = sorted(map(tuple, mixing.mix_copies(rows.repartition(7), spec, leaf=100, fan=3)[1].collect()), key=repr)
    assert a == b


def test_empty_tables(spark):
    rows, spec = rows_of(spark)
    plan, copies = mixing.mix_copies(rows.limit(0), spec)
    assert copies.collect() == [] and all(r["examples"] == 0 for r in plan.collect())
    plan, copies = mixing.mix_copies(rows, spec.limit(0))
    assert mixing.mix_shares(plan, copies).collect() == []


def test_found_equals_definition(spark, sf):
    t, m = spark.read.parquet(f"{sf}/train_rows.parquet"), spark.read.parquet(f"{sf}/mix_spec.parquet")
    n: dict = {}
    for r in mixing.examples_of(t).collect():
        n[r["key"]] = n.get(r["key"], 0) + 1
    spec = m.collect()
    total: dict = {}
    for r in spec:
        total[r["mix"]] = total.get(r["mix"], 0) + n.get(r["dataset"], 0)
    want = {(r["mix"], r["dataset"]) for r in spec if n.get(r["dataset"], 0) * r["max_repeats"] < r["target_share"] * total[r["mix"]]}
    plan, copies = mixing.mix_copies(t, m)
    assert {tuple(r) for r in mixing.short_sources(mixing.mix_shares(plan, copies)).collect()} == want
