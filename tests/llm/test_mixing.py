import pytest

from fedlens.llm import mixing

SCHEMA = "id long, source string, tokens long, copies string, copy string"
TARGETS = {"a": (0.5, 1), "b-c": (0.3, 2), "d": (0.2, 4), "none": (0.1, 3)}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA)


ROWS = [(i, "A ", 100 + i % 7) for i in range(3000)] + [(10_000 + i, ["b_c", "B-C", " b c"][i % 3], 50 + i % 11) for i in range(2000)] + [(20_000 + i, "d", 40) for i in range(100)] + [(30_000, None, 9), (30_001, "other", 9)]


def test_rates_reach_shares_within_caps():
    rates = mixing.rates({"a": 1000, "b-c": 300, "d": 10}, TARGETS)
    assert rates == pytest.approx({"a": 0.5 * 200 / 1000, "b-c": 0.3 * 200 / 300, "d": 4.0})
    assert mixing.rates({"a": 1000, "d": 10}, TARGETS, 2000.0) == {"a": 1.0, "d": 4.0}
    assert mixing.rates({}, TARGETS) == {}


def test_mix_has_its_shares(spark):
    mixed, rate, tokens = mixing.mix(frame(spark, ROWS), TARGETS)
    report = {r.source: r for r in mixing.shares(mixed, TARGETS, rate, tokens).collect()}
    assert set(report) == set(TARGETS) and report["none"].actual_share == 0
    for s in ("a", "b-c", "d"):
        assert abs(report[s].actual_share - TARGETS[s][0]) < 0.01 and report[s].most_copies <= TARGETS[s][1]
    per_doc = mixed.groupBy("id").count().collect()
    assert all(r["count"] == 4 for r in per_doc if r.id >= 20_000)


def test_copies_are_floor_or_one_more_and_repeatable(spark):
    first, rate, _ = mixing.mix(frame(spark, ROWS), TARGETS, total=400_000.0)
    again, _, _ = mixing.mix(frame(spark, ROWS).repartition(5), TARGETS, total=400_000.0)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted(map(tuple, again.collect()))
    copies = {r.id: r["count"] for r in first.groupBy("id").count().collect()}
    low = int(rate["b-c"])
    assert {copies.get(i, 0) for i, s, _ in ROWS if 10_000 <= i < 20_000} <= {low, low + 1}


def test_empty(spark):
    mixed, rate, tokens = mixing.mix(frame(spark, []), TARGETS)
    assert mixed.count() == 0 and {r.actual_share for r in mixing.shares(mixed, TARGETS, rate, tokens).collect()} == {0.0}
    assert mixing.mix(frame(spark, ROWS), {})[0].count() == 0
