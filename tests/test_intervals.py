import random

import pytest
from pyspark.sql import functions as F

from fedlens.common import to_nanos
from fedlens.operators import intervals

SCHEMA = "entity string, s long, e long, at string, piece string, step string"


def brute(rows):
    by = {}
    for entity, s, e, *_ in rows:
        if entity is not None and s is not None and e is not None and e > s:
            by.setdefault(entity, []).append((s, e))
    gaps, periods = [], []
    for entity, own in by.items():
        lo, hi = None, None
        for s, e in sorted(own):
            if hi is None or s > hi:
                if hi is not None:
                    gaps.append((entity, hi, s))
                    periods.append((entity, lo, hi))
                lo, hi = s, e
            hi = max(hi, e)
        periods.append((entity, lo, hi))
    return sorted(gaps), sorted(periods)


def both(spark, rows, hot):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    run = lambda f: sorted(map(tuple, f(df, F.col("entity"), F.col("s"), F.col("e"), hot).collect()))
    return run(intervals.gaps), run(intervals.periods)


@pytest.mark.parametrize("hot", [intervals.HOT, 8])
def test_overlap_nesting_touching_and_bad_ends(spark, hot):
    rows = [("a", 0, 10), ("a", 5, 7), ("a", 10, 12), ("a", 15, 20), ("a", 15, 20), ("a", 30, 30), ("a", 40, 35), ("a", 50, None), ("a", None, 60), (None, 1, 2), ("b", 3, 4)]
    assert both(spark, rows, hot) == ([("a", 12, 15)], [("a", 0, 12), ("a", 15, 20), ("b", 3, 4)]) == brute(rows)


@pytest.mark.parametrize("hot", [intervals.HOT, 20, 3])
def test_random_against_brute_force(spark, hot):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), s := rng.randrange(400), s + rng.randrange(-1, 6)) for _ in range(150)] + [("c", 0, 1)] * 30
    assert both(spark, rows, hot) == brute(rows)


def test_empty_table(spark):
    assert both(spark, [], intervals.HOT) == ([], [])


def test_units_of_instants(spark):
    ns = 1_735_689_733_294_740_863
    df = spark.createDataFrame([(ns,), (ns // 1000,), (ns // 1_000_000,), (ns // 1_000_000_000,), (None,)], "t long")
    assert [r[0] for r in df.select(to_nanos(F.col("t"))).collect()] == [ns, ns // 1000 * 1000, ns // 10**6 * 10**6, ns // 10**9 * 10**9, None]


def test_a_far_off_instant_does_not_put_a_hot_entity_in_one_piece(spark):
    rows = [("a", 10 * i, 10 * i + (12 if i % 3 else 5)) for i in range(300)] + [("a", 10**15, 10**15 + 5), ("b", 1, 2)]
    assert both(spark, rows, 60) == brute(rows)
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    line, cut = intervals.swept(df, F.col("entity"), F.col("s"), F.col("e"), 60)
    assert cut and max(r["count"] for r in line.groupBy("entity", "piece").count().collect()) <= 60
