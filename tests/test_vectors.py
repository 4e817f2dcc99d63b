import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fedlens.functions.generators import attacked_round
from fedlens.operators import vectors as V

SCHEMA = "round_id long, pos long, gradients array<float>"
ARGS = ("round_id", "pos", "gradients")


def frame(spark, *vectors, round_id=1):
    return spark.createDataFrame([(round_id, i, v) for i, v in enumerate(vectors)], SCHEMA)


def column(df):
    return [r["value"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_mean_median_and_trimmed_mean(spark):
    df = frame(spark, [1.0, 2.0], [3.0, 4.0])
    assert column(V.fedavg(df, *ARGS)) == column(V.trimmed_mean(df, *ARGS, ratio=0.0)) == [2.0, 3.0]
    assert column(V.coordinate_median(frame(spark, [1.0], [9.0], [2.0], [3.0]), *ARGS)) == [2.5]
    assert column(V.trimmed_mean(frame(spark, *[[float(i)] for i in (5, 5, 5, 0, 100)]), *ARGS)) == [5.0]
    assert column(V.trimmed_mean(frame(spark, [1.0], [2.0]), *ARGS, ratio=0.6)) == [1.5]  # the ratio is cut to 0.49


@pytest.mark.parametrize("hot", [5, 40])
def test_rounds_of_any_size_give_the_same(spark, hot):
    import random

    rng = random.Random(hot)
    rows = [(r, i, [rng.choice([0.5, -2.0, rng.gauss(0, 1), 1e6]) for _ in range(3)]) for r, n in ((1, 60), (2, 31), (3, 4)) for i in range(n)]
    rows[0][2][1] = float("nan")
    df = spark.createDataFrame(rows, SCHEMA)
    for f, k in ((V.trimmed_mean, {"ratio": 0.2}), (V.trimmed_mean, {"ratio": 0.0}), (V.coordinate_median, {})):
        one, many = ({(r["round"], r["i"]): r["value"] for r in f(df, *ARGS, **k, hot=h).collect()} for h in (V.HOT, hot))
        assert one.keys() == many.keys() and len(one) == 9
        assert all(many[x] == pytest.approx(one[x], nan_ok=True) for x in one)


def test_counts_follow_float_arithmetic(spark):
    n = spark.range(1)
    assert n.select(V.trim_count(F.lit(100), 0.29), V.kept_count(F.lit(10), 0.1)).first()[:] == (29, 1)


def test_mean_precision_against_double(spark):
    vectors = [[0.001 * i + 1e-7] * 4 for i in range(100)]
    want = statistics.fmean(0.001 * i + 1e-7 for i in range(100))
    assert all(abs(v / want - 1) < 1e-6 for v in column(V.fedavg(frame(spark, *vectors), *ARGS)))


def test_bad_rounds(spark):
    df = frame(spark, [1.0, 2.0], [3.0]).unionByName(frame(spark, [], [], round_id=2)).unionByName(frame(spark, [1.0], [2.0], round_id=3)).unionByName(frame(spark, [1.0], None, round_id=4))
    assert {r["round"]: r["error"] for r in V.round_errors(df, "round_id", "gradients").collect()} == dict.fromkeys((1, 2, 4), "invalid_gradient")
    assert V.fedavg(frame(spark), *ARGS).count() == 0


@pytest.mark.parametrize("hostile, n, f, dim", [(80.0, 14, 3, 48), (11.0, 17, 4, 40), (-2.0, 12, 2, 24)])
def test_robust_aggregates_stay_nearer_than_the_mean(spark, hostile, n, f, dim):
    df = attacked_round(spark, n, f, dim, hostile, 7)
    error = lambda out: sum((v - 1) ** 2 for v in column(out)) ** 0.5
    assert max(error(V.coordinate_median(df, *ARGS)), error(V.trimmed_mean(df, *ARGS, ratio=0.28))) < error(V.fedavg(df, *ARGS))
    best = V.krum(df, *ARGS, faulty=f).collect()
    assert len(best) == 1 and best[0]["sender"] < n - f
    assert error(V.multi_krum(df, *ARGS, faulty=f, selected=3)) < 0.5 and error(V.bulyan(df, *ARGS, faulty=f)) < 0.5


def test_nan_shows_in_the_mean(spark):
    assert any(not math.isfinite(v) for v in column(V.fedavg(attacked_round(spark, 9, 2, 4, math.nan, 1), *ARGS)))


def test_krum_limits_and_ties(spark):
    assert V.krum(frame(spark, *[[1.0]] * 51), *ARGS).count() == 0
    assert V.krum(frame(spark, *[[1.0]] * 4), *ARGS, faulty=1).count() == 0
    assert V.krum(frame(spark, *[[1.0]] * 6), *ARGS).first()["sender"] == 0


def compressed(spark, vec, ratio):
    return [(p["i"], p["value"]) for p in frame(spark, vec).select(V.top_k(F.col("gradients"), ratio)).first()[0]]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 33])
def test_top_k_equals_full_sort(spark, n):
    vec = [float((i * 7919) % 23 - 11) for i in range(n)]
    for ratio in (0.01, 0.25, 0.5, 1.0):
        k = max(1, math.ceil(round(n * ratio, 5)))
        assert compressed(spark, vec, ratio) == sorted((i, vec[i]) for i in sorted(range(n), key=lambda i: (-abs(vec[i]), i))[:k])


def test_top_k_ties_and_empty(spark):
    assert [i for i, _ in compressed(spark, [2.0, -2.0, 2.0, -2.0, 1.0, -1.0, 1.0, -1.0], 0.5)] == [0, 1, 2, 3]
    assert [i for i, _ in compressed(spark, [1.0, -3.0, 3.0, 0.2, -0.2, 8.0, -8.0, 5.0, -5.0, 0.0, -1.5, 1.5], 0.25)] == [5, 6, 7]
    assert compressed(spark, [], 0.5) == []


def test_sparse_and_dense(spark):
    df = spark.createDataFrame([([(0, 1.0), (2, 3.0), (0, 5.0)], 4), ([], 0)], "p array<struct<i:int,value:float>>, n int")
    assert [r[0] for r in df.select(V.dense(F.col("p"), F.col("n"))).collect()] == [[5.0, 0.0, 3.0, 0.0], []]
    bad = spark.createDataFrame([([0, 1], [1.0], 3), ([0, 99], [1.0, 2.0], 2), ([1], [1.0], 2)], "i array<int>, v array<float>, n int")
    assert [r[0] for r in bad.select(V.sparse_error(F.col("i"), F.col("v"), F.col("n"))).collect()] == ["invalid_data", "index_out_of_bounds", None]


def test_quantise(spark):
    df = frame(spark, [float("nan"), 300.0, -300.0, 1.9, -1.9, float("inf")])
    assert df.select(V.quantized_vector(F.col("gradients"), 1.0)).first()[0] == [0, 127, -128, 1, -1, 127]
    for scale in (0.0, float("nan"), -1.0, float("inf")):
        with pytest.raises(ValueError):
            V.quantized(F.lit(1.0), scale)


def test_verdicts(spark):
    df = frame(spark, [1.0], None, [], [0.0, float("nan"), float("inf")], [11.0], [float("-inf")], [9.0] * 200)
    got = [tuple(r[0]) for r in df.select(V.verdict(F.col("gradients"))).collect()]
    assert got == [("ok", None), ("empty", None), ("empty", None), ("nan", 1), ("too_large", 0), ("infinite", 0), ("norm_too_large", None)]


def test_transform_keeps_provenance_and_leaves_an_audit(spark):
    out, audit = V.transformed(frame(spark, [2.0, -4.0], round_id=9), "gradients", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)).cast("float"), "clip", "round_id")
    assert out.first()[:] == (9, 0, [1.0, -1.0]) and audit.first()[:] == ("clip", False, 9)


def test_trace_and_pipeline(spark):
    wide = spark.createDataFrame([(1, i, [0.0] * 1000) for i in range(8)], SCHEMA)
    assert V.cost_trace(wide, "round_id", "gradients", 0.1).first()[:] == (1, 1000, 8, 32_000, 8_000, 800)
    df = frame(spark, [1.0, 2.0, 3.0], [5.0, 6.0, 7.0])
    assert V.pipeline(df, *ARGS, how="fedavg", keep=1.0).first()["vec"] == V.pipeline(df, *ARGS, how="fedavg").first()["vec"] == [3.0, 4.0, 5.0]


def test_weighted_average_and_random_sparse(spark):
    df = frame(spark, [1.0], [4.0])
    assert column(V.weighted_average(df, *ARGS, F.when(F.col("pos") == 0, 2.0).otherwise(1.0))) == [2.0]
    kept = frame(spark, [1.0] * 1000).select(V.random_sparse(F.col("gradients"), F.lit(3), 0.5)).first()[0]
    assert 400 < len(kept) < 600 and kept[0]["value"] == 2.0


def test_krum_in_blocks_equals_krum_in_one_task(spark):
    rng = random.Random(11)
    rows = [[rng.gauss(0, 1) * (1e12 if i % 9 == 0 else 1) for _ in range(5)] for i in range(40)] + [[0.5] * 5] * 3
    df = frame(spark, *rows)
    whole = [(r["sender"], r["place"]) for r in V.krum(df, *ARGS, faulty=6, selected=43, max_peers=100).orderBy("place").collect()]
    for block in (7, 16):
        cut = V.krum(df, *ARGS, faulty=6, selected=43, max_peers=100, block=block)
        assert [(r["sender"], r["place"]) for r in cut.orderBy("place").collect()] == whole
    brute = {(i, j): sum((a - b) ** 2 for a, b in zip(rows[i], rows[j], strict=True)) for i in range(43) for j in range(i + 1, 43)}
    for block in (9, 100):
        got = {(r["sender"], r["other"]): r["distance"] for r in V.pairwise_distances(df, *ARGS, block=block).collect()}
        assert got.keys() == brute.keys() and all(abs(got[k] - brute[k]) <= 1e-6 * (1 + brute[k]) for k in brute)


def test_codecs_sizes_and_ratios(spark):
    df = spark.createDataFrame([([1.0, -3.0, 0.5, 2.0],), ([],), (None,)], "v array<float>")
    back = df.select(V.from_dense_bytes(V.dense_bytes("v")).alias("b"), V.from_dense_bytes(F.lit(b"abc")).alias("bad")).collect()
    assert [r["b"] for r in back] == [[1.0, -3.0, 0.5, 2.0], [], None] and back[0]["bad"] is None
    size = df.select(*[V.compressed_size(F.col("v"), h, 0.5).alias(h) for h in ("dense", "top_k", "int8", "top_k_int8")], V.compression_ratio(F.col("v"), "top_k_int8", 0.5).alias("r"), V.top_k_quantized(F.col("v"), 0.5, 0.5).alias("q")).collect()
    assert tuple(size[0])[:4] == (16, 16, 4, 10) and size[0]["r"] == 1.6 and size[1]["r"] == 1.0
    assert [tuple(p) for p in size[0]["q"]] == [(1, -6), (3, 4)]
