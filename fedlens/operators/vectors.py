"""Robust aggregates over sets of vectors, their compression and validation.

Two forms are used. Long form (round, i, value) lets column-wise aggregates combine in the map tasks and
spreads one wide round over its coordinates. Array form keeps whole vectors and uses higher-order functions,
for work on one vector at a time.

Ratios follow 32-bit float arithmetic: counts derived from them are computed as FLOAT products. NaN sorts
last; sums are double. Rounds with too few vectors or unequal lengths are named by `round_errors` and give
no rows elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIM, KRUM_PEERS = 10_000_000, 50
MAX_VALUE, MAX_NORM = 10.0, 100.0
TRIM, TRIM_MOST = 0.2, 0.49
BLOCK = 1024  # vectors of a round compared in one task with as many others
PAIR = pa.schema([("round", pa.int64()), ("sender", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])
SCORE = pa.schema([("round", pa.int64()), ("sender", pa.int64()), ("sum", pa.float64()), ("tops", pa.list_(pa.float64()))])
HOT = 1_000_000  # vectors of a round above which its coordinates are spread over several tasks


def long_form(df: DataFrame, round_col: str, sender: str, vec: str) -> DataFrame:
    """(round, sender, i, value)"""
    return df.select(F.col(round_col).alias("round"), F.col(sender).alias("sender"), F.posexplode(vec).alias("i", "value"))


def round_errors(df: DataFrame, round_col: str, vec: str) -> DataFrame:
    """(round, error) of the rounds no aggregate accepts: empty, too wide or unequal vectors."""
    size = F.coalesce(F.size(vec), F.lit(0))
    stats = df.groupBy(F.col(round_col).alias("round")).agg(F.min(size).alias("low"), F.max(size).alias("high"))
    return stats.filter((F.col("low") != F.col("high")) | (F.col("low") < 1) | (F.col("high") > MAX_DIM)).select("round", F.lit("invalid_gradient").alias("error"))


def fedavg(df: DataFrame, round_col: str, sender: str, vec: str) -> DataFrame:
    return long_form(df, round_col, sender, vec).groupBy("round", "i").agg(F.avg("value").alias("value"))


def weighted_average(df: DataFrame, round_col: str, sender: str, vec: str, weight: Column) -> DataFrame:
    rows = df.select(F.col(round_col).alias("round"), weight.alias("w"), F.posexplode(vec).alias("i", "value"))
    return rows.groupBy("round", "i").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def coordinate_median(df: DataFrame, round_col: str, sender: str, vec: str, hot: int = HOT) -> DataFrame:
    """Median of each coordinate, the mean of the two middle values if even."""
    busy = busy_rounds(df, round_col, hot)
    small, large = split_rounds(df, busy, round_col)
    out = long_form(small, round_col, sender, vec).groupBy("round", "i").agg(F.median("value").alias("value"))
    return out if large is None else out.unionByName(middle_mean(long_form(large, round_col, sender, vec), lambda n: F.floor((n - 1) / 2), hot))


def busy_rounds(df: DataFrame, round_col: str, hot: int) -> DataFrame | None:
    """Rounds of more than `hot` vectors, if there are any."""
    busy = df.groupBy(F.col(round_col).alias("__busy")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("__busy")
    return None if busy.isEmpty() else busy


def split_rounds(df: DataFrame, busy: DataFrame | None, round_col: str) -> tuple[DataFrame, DataFrame | None]:
    if busy is None:
        return df, None
    return df.join(busy, df[round_col] == busy["__busy"], "left_anti"), df.join(busy, df[round_col] == busy["__busy"], "left_semi")


def middle_mean(long: DataFrame, cut_of: Callable[[Column], Column], hot: int) -> DataFrame:
    """Exact mean of each coordinate without its `cut_of(n)` smallest and largest values, for rounds of any size.

    Equal values are counted together in the map tasks; a coordinate's values are spread over buckets between
    its approximate quantiles, so that no task sorts one whole coordinate. Counts before a bucket and counts
    within it give every value its ranks, and it enters the mean as often as those lie in the middle.
    """
    most = long.groupBy("round", "i").agg(F.count(F.lit(1)).alias("n"))
    parts = max(2, min(1000, -(-4 * int(most.agg(F.max("n")).first()[0] or 0) // hot)))
    bounds = long.groupBy("round", "i").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [k / parts for k in range(1, parts)], 10 * parts).alias("bounds"))
    bucket = F.size(F.filter("bounds", lambda b: b < F.col("value")))
    counted = long.groupBy("round", "i", "value").agg(F.count(F.lit(1)).alias("times")).join(bounds, ["round", "i"]).select("round", "i", "n", bucket.alias("bucket"), "value", "times")
    over = Window.partitionBy("round", "i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.groupBy("round", "i", "bucket").agg(F.sum("times").alias("all")).select("round", "i", "bucket", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("round", "i", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("reach", F.sum("times").over(inside)).join(before, ["round", "i", "bucket"])
    end, cut = F.col("before") + F.col("reach"), cut_of(F.col("n"))
    used = F.greatest(F.lit(0), F.least(end, F.col("n") - cut) - F.greatest(end - F.col("times"), cut))
    return ranked.select("round", "i", "value", used.alias("used")).filter("used > 0").groupBy("round", "i").agg((F.sum(F.col("value").cast("double") * F.col("used")) / F.sum("used")).alias("value"))


def trim_count(n: Column, ratio: float) -> Column:
    ratio = min(max(ratio, 0.0), TRIM_MOST)
    return F.floor(n.cast("float") * F.lit(ratio).cast("float")).cast("long")


def trimmed_mean(df: DataFrame, round_col: str, sender: str, vec: str, ratio: float = TRIM, hot: int = HOT) -> DataFrame:
    """Mean without the `trim_count` smallest and largest values of each coordinate; ties count singly."""
    small, large = split_rounds(df, busy_rounds(df, round_col, hot), round_col)
    w = Window.partitionBy("round", "i")
    ranked = long_form(small, round_col, sender, vec).select("round", "i", "value", F.row_number().over(w.orderBy("value", "sender")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    cut = trim_count(F.col("n"), ratio)
    out = ranked.filter((F.col("rn") > cut) & (F.col("rn") <= F.col("n") - cut)).groupBy("round", "i").agg(F.avg("value").alias("value"))
    return out if large is None else out.unionByName(middle_mean(long_form(large, round_col, sender, vec), lambda n: trim_count(n, ratio), hot))


def _round_vectors(df: DataFrame, round_col: str, sender: str, vec: str) -> DataFrame:
    return df.select(F.col(round_col).cast("long").alias("round"), F.col(sender).cast("long").alias("sender"), F.col(vec).cast("array<double>").alias("v"))


def distance_blocks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances (x, y), summed from differences so that huge values don't cancel small ones."""
    return np.stack([((y - row) ** 2).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)))


def _blocked(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(round, n, a, b, left, sender, v): every vector once as a left row for each block of its round, and once as a right row for each.

    A round of n vectors has n / block blocks, so n / block copies of each vector meet in tasks of two blocks.
    """
    placed = rows.join(sizes.select("round", "n"), "round").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
    own = placed.withColumn("own", F.pmod(F.xxhash64("round", "sender"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = own.select("round", "n", F.col("own").alias("a"), every.alias("b"), F.lit(True).alias("left"), "sender", "v")
    right = own.select("round", "n", every.alias("a"), F.col("own").alias("b"), F.lit(False).alias("left"), "sender", "v")
    return left.unionByName(right)


def pairwise_distances(df: DataFrame, round_col: str, sender: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(round, sender, other, distance): squared distances of all pairs of a round, sender before other; blocks of a round in tasks of their own."""
    rows = _round_vectors(df, round_col, sender, vec)
    sizes = rows.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).filter("low = high and low > 0")

    def pairs(_: tuple, t: pa.Table) -> pa.Table:
        left = t.column("left").to_numpy(zero_copy_only=False)
        names = t.column("sender").to_numpy()
        v = np.stack(t.column("v").to_pylist())
        if not left.any() or left.all():
            return PAIR.empty_table()
        i, j = np.nonzero(names[left][:, None] < names[~left][None, :])
        d = distance_blocks(v[left], v[~left])[i, j]
        return pa.table({"round": np.full(len(d), t.column("round")[0].as_py()), "sender": names[left][i], "other": names[~left][j], "distance": d}, schema=PAIR)

    return _blocked(rows, sizes, block).groupBy("round", "a", "b").applyInArrow(pairs, "round long, sender long, other long, distance double")


def krum_scores(rows: DataFrame, sizes: DataFrame, faulty: int, block: int) -> DataFrame:
    """(round, sender, score) of rounds of any size: the sum of a vector's n - faulty - 2 least distances to others.

    Each pair of blocks gives, per left vector, the sum of its distances to the right block without the faulty + 1
    largest, and these apart; over all blocks the faulty + 1 largest of those are left out and the others added.
    Only those lists are gathered per vector, never its distances.
    """
    aside = faulty + 1

    def part(_: tuple, t: pa.Table) -> pa.Table:
        left = t.column("left").to_numpy(zero_copy_only=False)
        names = t.column("sender").to_numpy()
        v = np.stack(t.column("v").to_pylist())
        if not left.any() or left.all():
            return SCORE.empty_table()
        d = distance_blocks(v[left], v[~left])
        same = names[left][:, None] == names[~left][None, :]
        d[same] = np.inf  # a vector is not its own neighbour; the padding is cut off below
        d = np.sort(d, axis=1)
        real = d.shape[1] - same.sum(1)
        cut = np.maximum(0, real - aside)
        sums = np.array([row[:c].sum() for row, c in zip(d, cut, strict=True)])
        tops = [row[c:r].tolist() for row, c, r in zip(d, cut, real, strict=True)]
        return pa.table({"round": np.full(len(d), t.column("round")[0].as_py()), "sender": names[left], "sum": sums, "tops": pa.array(tops, pa.list_(pa.float64()))}, schema=SCORE)

    parts = _blocked(rows, sizes, block).groupBy("round", "a", "b").applyInArrow(part, "round long, sender long, sum double, tops array<double>")
    merged = parts.groupBy("round", "sender").agg(F.sum("sum").alias("sum"), F.array_sort(F.flatten(F.collect_list("tops"))).alias("tops"))
    kept = F.slice("tops", 1, F.greatest(F.lit(0), F.size("tops") - aside))
    return merged.select("round", "sender", (F.col("sum") + F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)).alias("score"))


def krum(df: DataFrame, round_col: str, sender: str, vec: str, faulty: int = 1, selected: int = 1, max_peers: int = KRUM_PEERS, block: int = BLOCK) -> DataFrame:
    """(round, sender, score, place): per round the `selected` vectors nearest their n - faulty - 2 neighbours.

    A round of up to `block` vectors is one matrix inside a task, a larger one is spread over pairs of blocks, so
    no pair ever becomes a row. A round of more than `max_peers` vectors, or fewer than 2 * faulty + 3, gives no row.
    Senders name the vectors of a round and must not repeat in it.
    """
    rows = _round_vectors(df, round_col, sender, vec)
    sizes = rows.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"))
    good = sizes.filter(F.col("n").between(2 * faulty + 3, max_peers) & (F.col("low") == F.col("high")) & (F.col("low") > 0))

    def pick(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("sender")
        names = t.column("sender").to_numpy()
        x = np.stack(t.column("v").to_pylist())
        d = distance_blocks(x, x)
        np.fill_diagonal(d, np.inf)
        score = np.sort(d, axis=1)[:, : len(x) - faulty - 2].sum(1)
        order = np.argsort(score, kind="stable")[:selected]
        return pa.table({"round": np.full(len(order), key[0].as_py()), "sender": names[order], "score": score[order], "place": np.arange(1, len(order) + 1)})

    small = rows.join(good.filter(F.col("n") <= block).select("round"), "round", "left_semi").groupBy("round").applyInArrow(pick, "round long, sender long, score double, place long")
    if max_peers <= block:
        return small
    w = Window.partitionBy("round").orderBy("score", "sender")
    ranked = krum_scores(rows, good.filter(F.col("n") > block), faulty, block).withColumn("place", F.row_number().over(w).cast("long"))
    return small.unionByName(ranked.filter(F.col("place") <= selected))


def multi_krum(df: DataFrame, round_col: str, sender: str, vec: str, faulty: int, selected: int, max_peers: int = KRUM_PEERS) -> DataFrame:
    """Average of the `selected` best vectors of each round."""
    kept = krum(df, round_col, sender, vec, faulty, selected, max_peers).select(F.col("round").alias("k_round"), F.col("sender").alias("k_sender"))
    return fedavg(df.join(kept, (df[round_col] == kept.k_round) & (df[sender] == kept.k_sender), "left_semi"), round_col, sender, vec)


def bulyan(df: DataFrame, round_col: str, sender: str, vec: str, faulty: int, max_peers: int = KRUM_PEERS) -> DataFrame:
    """Trimmed mean, cutting `faulty` values at each end, over the n - 2 * faulty vectors with the best scores."""
    ranked = krum(df, round_col, sender, vec, faulty, max_peers, max_peers)
    sizes = ranked.groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    kept = ranked.join(sizes, "round").filter(F.col("place") <= F.col("n") - 2 * faulty).select(F.col("round").alias("k_round"), F.col("sender").alias("k_sender"))
    rows = long_form(df.join(kept, (df[round_col] == kept.k_round) & (df[sender] == kept.k_sender), "left_semi"), round_col, sender, vec)
    w = Window.partitionBy("round", "i")
    cut = rows.select("round", "i", "value", F.row_number().over(w.orderBy("value", "sender")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return cut.filter((F.col("n") > 2 * faulty) & (F.col("rn") > faulty) & (F.col("rn") <= F.col("n") - faulty)).groupBy("round", "i").agg(F.avg("value").alias("value"))


AGGREGATORS: dict[str, tuple[Callable[..., DataFrame], float, str]] = {
    "fedavg": (fedavg, 0.0, "linear"),
    "trimmed_mean": (trimmed_mean, TRIM, "linear"),
    "median": (coordinate_median, 0.5, "linear"),
    "krum": (krum, 0.33, "quadratic"),
}


def register_aggregator(name: str, f: Callable[..., DataFrame], tolerance: float = 0.0, complexity: str = "linear") -> None:
    """Make an aggregator of one's own known to `pipeline` under a name.

    It is called as f(df, round_col, sender, vec), `vec` an array column, and gives (round, i, value): a row per
    coordinate, from 0, of each round it accepts. `tolerance` is the share of hostile vectors it bears, below 0.5.
    """
    if name in AGGREGATORS or not name:
        raise ValueError("aggregator_exists" if name else "aggregator_unnamed")
    if not 0 <= tolerance <= 0.5:
        raise ValueError("bad_tolerance")
    AGGREGATORS[name] = (f, tolerance, complexity)


def gathered(long: DataFrame) -> DataFrame:
    """(round, vec) from (round, i, value)."""
    return long.groupBy("round").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"].cast("float")).alias("vec"))


def kept_count(size: Column, ratio: float) -> Column:
    return F.when(size == 0, 0).otherwise(F.least(size, F.greatest(F.lit(1), F.ceil(size.cast("float") * F.lit(ratio).cast("float")).cast("int"))))


def top_k(vec: Column, ratio: float) -> Column:
    """Array of (i, value): the values largest in size, equal ones by place, in order of place."""
    by_size = F.array_sort(F.transform(vec, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("i"), x.alias("value"))))
    best = F.slice(by_size, 1, kept_count(F.size(vec), ratio))
    return F.array_sort(F.transform(best, lambda e: F.struct(e["i"].alias("i"), e["value"].alias("value"))))


def sparse_error(indices: Column, values: Column, size: Column) -> Column:
    return F.when(F.size(indices) != F.size(values), "invalid_data").when(F.exists(indices, lambda i: (i < 0) | (i >= size)), "index_out_of_bounds")


def dense(pairs: Column, size: Column) -> Column:
    """Zeros with (i, value) put in; of a repeated index the last value counts."""
    index = F.transform(pairs, lambda p: p["i"])
    last = F.map_from_entries(F.transform(F.array_distinct(index), lambda i: F.struct(i, F.element_at(F.filter(pairs, lambda p: p["i"] == i), -1)["value"])))
    return F.when(size == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(last, i), F.lit(0.0).cast("float"))))


def quantized(value: Column, scale: float) -> Column:
    """value / scale cut to -128..127, truncated toward zero; NaN is 0. The scale must be finite and positive."""
    if not (scale > 0 and np.isfinite(scale)):
        raise ValueError("invalid_scale")
    v = value.cast("float") / F.lit(scale).cast("float")
    v = v.cast("float")
    return F.when(F.isnan(v), F.lit(0)).otherwise(F.greatest(F.lit(-128.0).cast("float"), F.least(F.lit(127.0).cast("float"), v)).cast("int")).cast("tinyint")


def restored(q: Column, scale: float) -> Column:
    if not (scale > 0 and np.isfinite(scale)):
        raise ValueError("invalid_scale")
    return (q.cast("float") * F.lit(scale).cast("float")).cast("float")


def quantized_vector(vec: Column, scale: float) -> Column:
    return F.transform(vec, lambda x: quantized(x, scale))


def random_sparse(vec: Column, seed: Column, share: float) -> Column:
    """Array of (i, value) chosen by a hash of seed and place, about `share` of them, scaled to keep the expected sum."""
    kept = F.filter(F.transform(vec, lambda x, i: F.struct(i.alias("i"), (x / share).cast("float").alias("value"))), lambda p: F.pmod(F.xxhash64(seed, p["i"]), F.lit(1_000_000)) < int(share * 1_000_000))
    return kept


def top_k_quantized(vec: Column, ratio: float, scale: float) -> Column:
    """Array of (i, q): the values `top_k` keeps, as signed bytes."""
    return F.transform(top_k(vec, ratio), lambda p: F.struct(p["i"].alias("i"), quantized(p["value"], scale).alias("q")))


@F.pandas_udf(T.BinaryType())
def dense_bytes(vec: pd.Series) -> pd.Series:
    """The values as 32-bit floats, little end first, without a header."""
    return vec.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_dense_bytes(data: pd.Series) -> pd.Series:
    """The values of `dense_bytes`; null where the length is no multiple of four."""
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def compressed_size(vec: Column, how: str, ratio: float = 1.0) -> Column:
    """Bytes of a vector: dense 4 each, top_k and random_sparse 8 per pair, int8 1 each, top_k_int8 5 per pair."""
    n = F.size(vec)
    kept = kept_count(n, ratio)
    return {"dense": n * 4, "top_k": kept * 8, "random_sparse": kept * 8, "int8": n, "top_k_int8": kept * 5}[how].cast("long")


def compression_ratio(vec: Column, how: str, ratio: float = 1.0) -> Column:
    """Dense bytes over compressed bytes; 1 for an empty vector."""
    return F.when(F.size(vec) == 0, F.lit(1.0)).otherwise(F.size(vec) * 4.0 / compressed_size(vec, how, ratio))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_error(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def value_error(x: Column, most: float) -> Column:
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "infinite").when(F.abs(x) > most, "too_large")


def verdict(vec: Column, most: float = MAX_VALUE, most_norm: float = MAX_NORM) -> Column:
    """STRUCT<reason, at>: the first value that is NaN, infinite or too large, else the norm; reason `ok` if all is well."""
    found = F.filter(F.transform(vec, lambda x, i: F.struct(value_error(x, most).alias("reason"), i.alias("at"))), lambda e: e["reason"].isNotNull())
    return (
        F.when(vec.isNull() | (F.size(vec) == 0), F.struct(F.lit("empty").alias("reason"), F.lit(None).cast("int").alias("at")))
        .when(F.size(found) > 0, F.try_element_at(found, F.lit(1)))
        .when(norm(vec) > most_norm, F.struct(F.lit("norm_too_large").alias("reason"), F.lit(None).cast("int").alias("at")))
        .otherwise(F.struct(F.lit("ok").alias("reason"), F.lit(None).cast("int").alias("at")))
    )


def transformed(df: DataFrame, vec: str, change: Callable[[Column], Column], name: str, round_col: str, trusted: bool = False) -> tuple[DataFrame, DataFrame]:
    """`df` with each value changed and all else kept, and the audit (transform_name, core_trusted, round_id)."""
    audit = df.select(F.lit(name).alias("transform_name"), F.lit(trusted).alias("core_trusted"), F.col(round_col).alias("round_id")).distinct()
    return df.withColumn(vec, F.transform(vec, change)), audit


def cost_trace(df: DataFrame, round_col: str, vec: str, ratio: float | None = None) -> DataFrame:
    """(round, dim, peers, memory_bytes, flops, compressed_bytes)"""
    sizes = df.groupBy(F.col(round_col).alias("round")).agg(F.max(F.size(vec)).cast("long").alias("dim"), F.count(F.lit(1)).alias("peers"))
    packed = (kept_count(F.col("dim"), ratio) * 8).cast("long") if ratio is not None else F.lit(None).cast("long")
    most = F.lit(2**63 - 1)
    return sizes.select("round", "dim", "peers", F.coalesce(F.try_multiply(F.try_multiply(F.col("dim"), F.col("peers")), F.lit(4)), most).alias("memory_bytes"), F.coalesce(F.try_multiply(F.col("dim"), F.col("peers")), most).alias("flops"), packed.alias("compressed_bytes"))


def pipeline(df: DataFrame, round_col: str, sender: str, vec: str, how: str = "trimmed_mean", keep: float | None = None) -> DataFrame:
    """(round, vec): aggregate, then compress and restore if `keep` is given."""
    out = gathered(AGGREGATORS[how][0](df, round_col, sender, vec))
    return out if keep is None else out.withColumn("vec", dense(top_k(F.col("vec"), keep), F.size("vec")))
