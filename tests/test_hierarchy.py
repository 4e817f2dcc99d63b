import random

import pytest
from pyspark.sql import functions as F

from fedlens.operators import hierarchy as tree

SCHEMA = "entity string, node string, parent string, root string, path string"


def brute(rows):
    up = {}
    for e, n, p, *_ in rows:
        if e is not None and n is not None:
            old = up.get((e, n))
            up[e, n] = p if old is None else old if p is None else min(old, p)
    out = []
    for (e, n), p in up.items():
        p = p if (e, p) in up else None
        way, at = [n], n
        while True:
            nxt = up[e, at]
            if (e, nxt) not in up:
                out.append((e, n, p, at, len(way) - 1, None, "/".join(reversed(way))))
                break
            if nxt in way:
                out.append((e, n, p, None, None, min(way[way.index(nxt) :]), None))
                break
            way.append(nxt)
            at = nxt
    return sorted(out, key=repr)


def run(spark, rows, hot=tree.HOT, paths=True):
    df = spark.createDataFrame([(*r, "r", "p") for r in rows], SCHEMA)
    return sorted(map(tuple, tree.hierarchy(df, F.col("entity"), F.col("node"), F.col("parent"), paths, hot).collect()), key=repr)


@pytest.mark.parametrize("hot", [tree.HOT, 0])
def test_trees_loops_and_dirt(spark, hot):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "c", "b"), ("t", "d", "gone"), ("t", "s", "s"), ("t", "u", "s"), ("t", "x", "z"), ("t", "y", "x"), ("t", "z", "y"), ("t", "w", "y"), ("t", "e", None), ("t", "e", "a"), ("u", "b", "a"), (None, "a", None), ("t", None, "a")]
    assert run(spark, rows, hot) == brute(rows)


@pytest.mark.parametrize("hot", [tree.HOT, 30])
def test_random_against_brute_force(spark, hot):
    rng = random.Random(6)
    rows = [(e, f"n{i:03}", rng.choice([None, f"n{rng.randrange(n):03}", f"n{max(0, i - 1):03}"])) for e, n in (("p", 120), ("q", 25), ("r", 60)) for i in range(n)]
    rows += rows[::7]
    assert run(spark, rows, hot) == brute(rows)


def test_deep_chain_over_chunk_bounds(spark, monkeypatch):
    monkeypatch.setattr(tree, "CHUNK", 50)
    rows = [(f"g{g}", f"n{i:04}", f"n{i - 1:04}" if i else None) for g in range(3) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_descendants(spark):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "l", "l")]
    df = spark.createDataFrame([(*r, "r", "p") for r in rows], SCHEMA)
    below = tree.descendants(tree.hierarchy(df, F.col("entity"), F.col("node"), F.col("parent")))
    assert sorted(map(tuple, below.collect())) == [("t", "a", "b", 1), ("t", "a", "c", 2), ("t", "b", "c", 1)]


@pytest.mark.parametrize("hot", [tree.HOT, 0])
def test_descendants_on_and_below_loops(spark, hot):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "x", "z"), ("t", "y", "x"), ("t", "z", "y"), ("t", "w", "y"), ("t", "v", "w"), ("t", "s", "s"), ("t", "u", "s")]
    df = spark.createDataFrame([(*r, "r", "p") for r in rows], SCHEMA)
    found = tree.hierarchy(df, F.col("entity"), F.col("node"), F.col("parent"), hot=hot)
    below = tree.descendants(tree.loops_cut(found, hot), "cycle")
    true = {None: ["ab1"], "x": ["xy1", "xz2", "yz1", "xw2", "yw1", "xv3", "yv2", "wv1"], "s": ["su1"]}
    assert sorted(map(tuple, below.collect()), key=repr) == sorted((("t", a, n, int(far), c) for c in true for a, n, far in true[c]), key=repr)


def test_empty(spark):
    assert run(spark, []) == []


def test_descendants_of_ids_that_hold_slashes(spark):
    df = spark.createDataFrame([("t", "a/b", None), ("t", "c", "a/b"), ("t", "d/", "c")], "e string, n string, p string")
    for hot in (tree.HOT, 1):
        found = tree.hierarchy(df, df.e, df.n, df.p, hot=hot, between="\x1f")
        assert sorted((r["ancestor"], r["node"], r["distance"]) for r in tree.descendants(found, between="\x1f").collect()) == [("a/b", "c", 1), ("a/b", "d/", 2), ("c", "d/", 1)]
