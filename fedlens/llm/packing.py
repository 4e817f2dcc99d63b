"""Filling containers of fixed capacity with items, by non-negative least squares over the length histogram.

Plan, on the driver, from the histogram of lengths (at most one number per length up to the capacity, so its
size has nothing to do with the number of items): enumerate shallow combinations of lengths, up to three
lengths of which the first two may repeat, that fill a window below the capacity; solve how often to use
each by non-negative least squares against the histogram; round down to whole containers the histogram can
pay for; pack what is left greedily, longest first, repeating a pattern as long as its lengths last. How many
combinations are weighed is bounded by parameters that hold at every size: of the middle length of a triple
`MIDDLES` values are tried, of all combinations `MOST` are kept, both evenly spaced; that narrows the choice of
patterns, and no item is ever left out.

Assignment, distributed: items of a length are interchangeable, so the k-th item of a length takes the k-th
slot the plan has for it. Ranks come from (length, bucket) counts and a rank within each bucket, buckets
being hashes of the id; a length that a third of all items share spreads over as many tasks as any other.

Defined results: an item longer than the capacity is cut into full parts and one remainder, all others stay
whole; an item of no length, null included, is in no container; equal ids are told apart by part only, so
repeated rows of one id are repeated items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS, ROUNDS, MOST, MIDDLES = 100_000, 400, 300_000, 600


@dataclass
class Plan:
    """Slots per length: ranks from `first` on take containers from `base` on, `copies` to a container."""

    capacity: int
    containers: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    patterns: list[tuple[dict[int, int], int]]


def combinations(lengths: np.ndarray, capacity: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, copies), three columns each and 0 where unused: combinations that fill capacity - window or more."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    found = [np.stack([lengths, capacity // lengths, *[np.zeros_like(lengths)] * 4], axis=1)]
    for i in range(1, 1 + int(capacity // lengths[0]) if len(lengths) else 1):
        a = lengths[lengths * i <= capacity]
        rest = capacity - a * i
        for j in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32):  # copies of the second length
            for short in range(window + 1):
                b, over = np.divmod(rest - short, j)
                ok = (over == 0) & (b > 0) & (b <= capacity)
                ok[ok] = have[b[ok]]
                ok &= b != a
                found.append(np.stack([a[ok], np.full(ok.sum(), i), b[ok], np.full(ok.sum(), j), np.zeros(ok.sum(), int), np.zeros(ok.sum(), int)], axis=1))
        if i <= 4:
            for b in lengths[np.unique(np.linspace(0, len(lengths) - 1, MIDDLES).astype(int))]:  # three lengths, the first repeated i times
                c = rest - b
                ok = (c > 0) & (c < b)
                ok[ok] = have[c[ok]]
                ok &= (a != b) & (a != c)
                n = int(ok.sum())
                found.append(np.stack([a[ok], np.full(n, i), np.full(n, b), np.ones(n, int), c[ok], np.ones(n, int)], axis=1))
    every = np.concatenate(found)
    filled = (every[:, 0::2] * every[:, 1::2]).sum(1)
    every = every[(filled <= capacity) & (filled >= capacity - window)]
    if len(every) > MOST:
        every = every[np.linspace(0, len(every) - 1, MOST).astype(int)]
    return every[:, 0::2], every[:, 1::2]


def least_squares(which: np.ndarray, copies: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 minimising the weighted square of counts - A x, A given by columns; accelerated projected gradient."""
    n, m = len(counts), len(which)
    flat, times = which.ravel(), copies.ravel().astype(float)
    weight = np.sqrt(np.arange(n) / max(1, n - 1)) + 0.05  # long items are harder to place later
    forward = lambda x: np.bincount(flat, weights=times * np.repeat(x, 3), minlength=n)[:n]
    backward = lambda r: (times * r[flat]).reshape(m, 3).sum(1)
    w2 = weight * weight
    w2[0] = 0
    v = np.ones(m)
    for _ in range(20):
        v = backward(w2 * forward(v))
        size = np.linalg.norm(v)
        if size == 0:
            return np.zeros(m)
        v /= size
    step, x, y, t = 1 / (1.05 * size), np.zeros(m), np.zeros(m), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + step * backward(w2 * (counts - forward(y))))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def greedy(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and repeats that place all of `left`: the longest length first, then whatever longest still fits."""
    out = []
    while left.any():
        pattern, room = {}, capacity
        for length in np.flatnonzero(left)[::-1]:
            n = min(room // int(length), int(left[length]))
            if n:
                pattern[int(length)] = n
                room -= n * int(length)
            if not room:
                break
        times = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * times
        out.append((pattern, times))
    return out


def plan(histogram: dict[int, int], capacity: int, window: int | None = None) -> Plan:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, patterns = counts.copy(), []
    if left[capacity]:
        patterns.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        which, copies = combinations(lengths, capacity, max(0, capacity // 256) if window is None else window)
        if len(which):
            total = left.sum()
            x = least_squares(which, copies, left / total) * total
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                need = {int(a): int(c) for a, c in zip(which[k], copies[k], strict=True) if c}
                times = min(int(x[k]), *[int(left[a]) // c for a, c in need.items()])
                if times:
                    patterns.append((need, times))
                    for a, c in need.items():
                        left[a] -= c * times
        patterns += greedy(left, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, base = np.zeros(capacity + 1, dtype=np.int64), 0
    for need, times in patterns:
        for length, c in need.items():
            slots.setdefault(length, []).append((int(used[length]), base, c))
            used[length] += c * times
        base += times
    return Plan(capacity, base, {length: tuple(np.array(v, dtype=np.int64) for v in zip(*rows, strict=True)) for length, rows in slots.items()}, patterns)


def items(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, part, length): items of (id, tokens), cut only above the capacity."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / F.lit(capacity)) - 1))
    return sizes.filter("id is not null and tokens > 0").select("id", "tokens", parts.alias("part")).select("id", "part", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * capacity).cast("int").alias("length"))


def pack(sizes: DataFrame, capacity: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Plan]:
    """(container, id, part, length) for (id, tokens), and the plan."""
    every = items(sizes, capacity)
    histogram = {r["length"]: r["count"] for r in every.groupBy("length").count().collect()}  # at most `capacity` rows
    made = plan(histogram, capacity)
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    placed = every.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "part")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"]).select("id", "part", "length", (F.col("rank") + F.col("offset")).alias("rank"))
    shared = sizes.sparkSession.sparkContext.broadcast(made.slots)  # bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for b in batches:
            if b.num_rows:
                length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
                container = np.zeros(len(length), dtype=np.int64)
                for n in np.unique(length):
                    own = np.flatnonzero(length == n)
                    first, base, copies = slots[int(n)]
                    k = np.searchsorted(first, rank[own], side="right") - 1
                    container[own] = base[k] + (rank[own] - first[k]) // copies[k]
                yield pa.RecordBatch.from_arrays([pa.array(container), b.column("id"), b.column("part"), b.column("length")], ["container", "id", "part", "length"])

    return ranked.mapInArrow(run, "container long, id long, part long, length int"), made
