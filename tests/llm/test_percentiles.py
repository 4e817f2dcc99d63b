import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedlens.llm import percentiles as P

SCHEMA = "g string, day int, value double, n string, error string, level string, salt string"
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def off(values, got, share):
    """Distance of the answer's ranks from the one asked for."""
    want, lo, hi = math.ceil(share * len(values)), sum(v < got for v in values) + 1, sum(v <= got for v in values)
    return max(0, lo - want, want - hi)


@pytest.mark.parametrize("n", [1, 7, 64, 1000, 30_000])
def test_bound_holds_when_split_and_merged(n):
    rng = np.random.default_rng(n)
    values = rng.choice([rng.normal(size=n), rng.exponential(size=n).round(1)], axis=0)
    parts = [P.Sketch(64) for _ in range(3)]
    for i, chunk in enumerate(np.array_split(values, 9)):
        parts[i % 3].add(chunk)
    whole = P.Sketch(64)
    for s in parts:
        whole.count(s.n, s.error)
        for level, b in s.buffers():
            whole.merge(level, b)
    assert whole.n == n and (n > 64 or whole.bound() == 0)
    for share, got in zip((0.01, 0.5, 0.95, 0.99), whole.at([0.01, 0.5, 0.95, 0.99]), strict=True):
        assert off(values, got, share) <= whole.bound() <= max(0, n * 10 / 64)


def test_groups_periods_and_merging(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.choice([1, 2, None]), rng.choice([rng.gauss(0, 1), 5.0]), "n", "e", "l", "s") for _ in range(4000)]
    dirty = [("a", 1, v, "", "", "", "") for v in (None, float("nan"), float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows + dirty, SCHEMA).repartition(7)
    built = P.sketches(df, F.col("value"), {"g": F.col("g"), "day": F.col("day")}, size=128, fan=3)
    daily = {(r.g, r.day): r for r in P.percentiles(built, ["g", "day"], SHARES, 128).collect()}
    whole = {r.g: r for r in P.percentiles(built, ["g"], SHARES, 128).collect()}
    for found, key in ((daily, lambda r: (r[0], r[1])), (whole, lambda r: r[0])):
        assert set(found) == {key(r) for r in rows}
        for k, r in found.items():
            own = [x[2] for x in rows if key(x) == k]
            assert r.n == len(own)
            for name, share in SHARES.items():
                assert off(own, r[name], share) <= r.max_rank_error <= len(own) * 0.05


def test_empty_and_all_unusable(spark):
    for rows in ([], [("a", 1, None, "", "", "", "")]):
        built = P.sketches(spark.createDataFrame(rows, SCHEMA), F.col("value"), {"g": F.col("g")})
        assert P.percentiles(built, ["g"], SHARES).count() == 0
