import numpy as np
import pytest

from fedlens.llm import additive, neighbours

SCHEMA = "id long, vec array<float>, query string, v string, cls string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "q", "v", "c") for i, v in zip(ids, vectors)], SCHEMA)


def brute(ids, x, k, least=-2.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(cos[a, b], 6), ids[b]))[:k]
        out |= {(ids[a], ids[b]) for b in order if cos[a, b] >= least}
    return out


def pairs(df):
    return {(r.query, r.other) for r in df.collect()}


def planted(rng, n, dim=16):
    base = rng.normal(size=(n, dim))
    near = base[: n // 4] + 0.05 * rng.normal(size=(n // 4, dim))
    return np.concatenate([base, near * rng.uniform(1e-3, 1e3, size=(n // 4, 1))])


@pytest.mark.parametrize("cap", [neighbours.CAP, 20])
def test_close_pairs_against_brute_force(spark, cap):
    x = planted(np.random.default_rng(1), 400)
    ids = list(range(100, 100 + len(x)))
    got = pairs(neighbours.similar(frame(spark, ids, x), dim=16, least=0.95, cap=cap))
    true = brute(ids, x, 5, 0.95)
    assert len(true) > 150 and len(got & true) >= 0.99 * len(true) and got <= true


def test_query_set_recall_and_exact(spark):
    x = planted(np.random.default_rng(2), 800)
    ids = list(range(len(x)))
    df = frame(spark, ids, x)
    true = {p for p in brute(ids, x, 5) if p[0] % 100 == 0}
    assert pairs(neighbours.similar(df, dim=16, queries="rep % 100 = 0", exact=True)) == true
    assert len(pairs(neighbours.similar(df, dim=16, queries="rep % 100 = 0", short=60)) & true) >= 0.9 * len(true)


def test_recall_of_the_index_with_production_probes(spark):
    x = np.random.default_rng(5).normal(size=(8000, 32))
    ids = list(range(len(x)))
    df = frame(spark, ids, x)
    true = pairs(neighbours.similar(df, dim=32, queries="rep % 100 = 0", exact=True))
    every = {p for p in pairs(neighbours.similar(df, dim=32)) if p[0] % 100 == 0}
    assert len(every & true) >= 0.9 * len(true) == 360
    assert pairs(neighbours.similar(df, dim=32, queries="rep % 100 = 0", through_index=True)) == every


def test_lists_laid_into_slots():
    first, blocks = neighbours.laid_out({0: 3, 1: 4, 3: 25, 4: 1, 5: 10}, 6, 10)
    assert list(zip(first, blocks)) == [(0, 1), (0, 1), (0, 0), (1, 3), (4, 1), (5, 1)]


def test_copies_are_expanded_but_bounded(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 8))
    copies = np.concatenate([np.repeat(x[:1], 20, axis=0), np.repeat(x[1:2], 3, axis=0), x[2:]])
    ids = list(range(len(copies)))
    assert pairs(neighbours.similar(frame(spark, ids, copies), dim=8, probes=64)) == brute(ids, copies.astype(np.float32).astype(float), 5)


@pytest.mark.parametrize("how", [{"exact": True}, {}, {"through_index": True, "probes": 64}])
def test_queries_are_told_by_their_own_id(spark, how):
    x = np.random.default_rng(6).normal(size=(30, 8))
    x = np.concatenate([np.repeat(x[:1], 4, axis=0), np.repeat(x[1:2], 9, axis=0), x[2:]])
    ids = [150, 200, 300, 301, 100, 101, 102, 103, 104, 105, 106, 107, 400, *range(500, 500 + len(x) - 13)]
    got = pairs(neighbours.similar(frame(spark, ids, x), dim=8, queries="rep % 100 = 0", **how))
    assert got == {p for p in brute(ids, x.astype(np.float32).astype(float), 5) if p[0] % 100 == 0}


def test_vectors_that_take_no_part_and_repeated_ids(spark):
    good = [[1, 0, 0, 1], [1, 0, 0, 1.01], [0, 1, 0, 0]]
    bad = [None, [1, 0], [0, 0, 0, 0], [1, float("nan"), 0, 0], [1, float("inf"), 0, 0], [1, None, 0, 0], []]
    df = frame(spark, [1, 2, 3, 1, *range(10, 17)], [*good, good[0], *bad])
    assert pairs(neighbours.similar(df, dim=4)) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert neighbours.similar(frame(spark, [], []), dim=4).count() == 0
    assert neighbours.similar(frame(spark, [9], bad[:1]), dim=4).count() == 0


def test_kernels():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = additive.train(x, 8, stages=4, entries=16)
    errors = [((x - additive.decode(additive.encode(x, made.books, beam), made.books)) ** 2).sum() for beam in (1, 8)]
    assert errors[1] < errors[0] < (x**2).sum()
    codes = additive.encode(x, made.books)
    decoded = additive.decode(codes, made.books)
    norms = np.linalg.norm(decoded, axis=1)
    assert np.allclose(additive.score(additive.tables(x[:5], made.books), codes, norms), x[:5] @ decoded.T / norms, atol=1e-5)
