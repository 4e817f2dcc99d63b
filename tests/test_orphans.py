import datetime as dt
import random

import pytest

from fedlens.common import asset_form, plain
from fedlens.operators import orphans

T = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
REFS = "kind string, key string, at timestamp, ref_id long, since string, until string"
TARGETS = "kind string, key string, since timestamp, until timestamp"


def brute(refs, targets):
    live = lambda k, key, at: any(k == a and key == b and s is not None and ((at is None and (u is None or u > s)) or (at is not None and s <= at and (u is None or at < u))) for a, b, s, u in targets)
    return sorted(r[3] for r in refs if r[0] is not None and r[1] is not None and not live(*r[:3]))


def run(spark, refs, targets, **k):
    return sorted(r.ref_id for r in orphans.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), **k).collect())


@pytest.mark.parametrize("share, intervals", [(2.0, 200), (0.0, 200), (0.3, 200), (0.0, 1)])
def test_bounds_of_life_and_returns(spark, share, intervals):
    targets = [("n", "a", T(10), T(20)), ("n", "a", T(10), T(20)), ("n", "a", T(30), None), ("n", "b", T(5), T(5)), ("n", "c", None, None), ("m", "a", T(0), None)]
    refs = [("n", k, T(h) if h is not None else None, i, "s", "u") for i, (k, h) in enumerate([("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 30), ("b", 5), ("c", 1), ("x", 1), (None, 1), ("a", None), ("x", None)])]
    assert run(spark, refs, targets, share=share, intervals=intervals) == brute(refs, targets)


@pytest.mark.parametrize("share, intervals", [(2.0, 200), (0.1, 200), (0.0, 200), (0.0, 1)])
def test_random_against_brute_force(spark, share, intervals):
    rng = random.Random(7)
    targets = [("n", rng.choice("abcdef"), T(s := rng.randrange(50)), rng.choice([None, T(s + rng.randrange(20))])) for _ in range(12)]
    refs = [("n", rng.choice("aaaabcdefgh"), T(rng.randrange(70)), i, "s", "u") for i in range(300)]
    assert run(spark, refs, targets, share=share, intervals=intervals) == brute(refs, targets)


def test_heavy_keys_are_found_by_their_share_and_bounded(spark):
    refs = spark.createDataFrame([("n", "a", T(i), i, "", "") for i in range(60)] + [("n", f"k{i}", T(i), i, "", "") for i in range(40)], REFS)
    live = orphans.live_intervals(spark.createDataFrame([("n", "a", T(3 * i), T(3 * i + 1)) for i in range(20)] + [("n", "k1", T(0), None)], TARGETS))
    counts = orphans.counted(refs, [])
    assert orphans.heavy_keys(counts, live, 0.5) == [("n", "a")]
    assert orphans.heavy_keys(counts, live, 0.5, intervals=19) == []


def test_empty_tables(spark):
    assert run(spark, [], []) == [] and run(spark, [("n", "a", T(1), 1, "", "")], []) == [1]


def test_report(spark):
    refs = spark.createDataFrame([("n", "a", T(1), 1, "", ""), ("n", "b", T(1), 2, "", ""), ("n", "b", T(24 * 40), 3, "", "")], REFS)
    targets = spark.createDataFrame([("n", "a", T(0), None)], TARGETS)
    assert sorted(map(tuple, orphans.orphan_report(refs.unionByName(refs), targets, ["kind"]).collect())) == [("n", "2025-01", 2, 1), ("n", "2025-02", 1, 1)]


def test_forms_of_keys(spark):
    df = spark.createDataFrame([(" Ab ",), ("dataset://X/y/ ",), ("  ",), (None,), ("//",)], "k string")
    assert [tuple(r) for r in df.select(plain(df.k), asset_form(df.k)).collect()] == [("ab", "ab"), ("dataset://x/y/", "dataset://x/y"), (None, None), (None, None), ("//", None)]


def test_report_counts_as_rows_do(spark):
    rng = random.Random(9)
    targets = [("n", rng.choice("abcdef"), T(s := rng.randrange(1500)), rng.choice([None, T(s + rng.randrange(400))])) for _ in range(12)]
    refs = [("n", rng.choice("aaaabcdefgh"), rng.choice([T(rng.randrange(2000)), None]), i, "s", rng.choice(["u", None])) for i in range(300)]
    r, t = spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)
    month = lambda x: None if x is None else x.strftime("%Y-%m")
    lost = set(brute(refs, targets))
    want = {}
    for _, _, at, i, _, u in refs:
        n = want.setdefault((u, month(at)), [0, 0])
        n[0] += 1
        n[1] += i in lost
    for share in (2.0, 0.1, 0.0):
        assert {(x["until"], x["month"]): [x["refs"], x["orphans"]] for x in orphans.orphan_report(r, t, ["until"], share=share).collect()} == want
