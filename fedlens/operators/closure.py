"""Everything upstream of everything: the transitive closure of directed edges, and its size per node.

Scale: counting needs no row per pair. Nodes get numbers, parents before children, and a node's ancestors are
the bits of one integer, the union of its parents' bits. Bits are worked through in blocks, so that a task holds
`BYTES` of them at most; the blocks are independent and spread over tasks, and a block ends at the last node
that anything in it leads to. That is edges x nodes / 64 word operations at worst.

Up to `MOST` edges are numbered on the driver and broadcast. Above that, connected components are told apart by
joins; components of up to `MOST` edges are counted whole inside tasks, larger ones by pairs as in `closure`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedlens.common import staged

MOST = 1_000_000
BYTES = 200_000_000
CHUNK = 100_000
COUNTS = "id long, ancestors long"


def closure(edges: DataFrame, source: str, target: str, most_rounds: int = 64) -> DataFrame:
    """(source, target) for every pair joined by a way of one edge or more; loops are allowed.

    After round k the pairs known are those less than 2^(k+1) edges apart: a pair further apart is a way of
    exactly 2^k edges followed by a known one, so a pair is found through few middles only and a depth of d
    takes log2(d) rounds. Every round's pairs are written to the shared folder. Edges with a null end do not
    count. The result may be far larger than the input: it has a row per pair.
    """
    base = edges.select(edges[source].alias("source"), edges[target].alias("target")).dropna().distinct()
    known = leap = staged(base, "closure-0")
    after = lambda first, then: first.select("source", first["target"].alias("via")).join(then.select(then["source"].alias("via"), "target"), "via").select("source", "target")
    for k in range(1, most_rounds + 1):
        leap = staged(after(leap, leap).distinct(), f"closure-leap-{k}")
        fresh = staged(leap.unionByName(after(leap, known)).distinct().join(known, ["source", "target"], "left_anti"), f"closure-{k}")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise ValueError("closure did not end")


class Order(NamedTuple):
    """Loops as one part each, every part after those that lead to it."""

    ids: np.ndarray  # of nodes
    part: np.ndarray  # of the nodes
    begin: np.ndarray  # part p is led to by up[begin[p] : begin[p + 1]]
    up: np.ndarray
    bit: np.ndarray  # part p has the bits from bit[p] to bit[p + 1]; none if it leads nowhere
    loop: np.ndarray  # whether its nodes are their own ancestors
    last: np.ndarray  # the last part it leads to


def ordered(source: np.ndarray, target: np.ndarray) -> Order:
    """Order of edges without repeats; ends are any integers."""
    ids, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
    source, target = ends[: len(source)], ends[len(source) :]
    by = np.argsort(target, kind="stable")
    part, n = parts(np.searchsorted(target[by], np.arange(len(ids) + 1)), source[by])
    loop = np.bincount(part, minlength=n) > 1
    a, b = part[source], part[target]
    loop[a[source == target]] = True
    b, a = np.divmod(np.unique(b[a != b] * np.int64(max(n, 1)) + a[a != b]), max(n, 1))
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, a, b)
    wide = np.where(loop | (last > 0), np.bincount(part, minlength=n), 0)
    return Order(ids, part, np.searchsorted(b, np.arange(n + 1)), a, np.concatenate([[0], np.cumsum(wide)]), loop, last)


def parts(begin: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, int]:
    """Strongly connected part of every node, numbered parents first, and how many there are: Tarjan's method against the edges, without recursion."""
    n = len(begin) - 1
    at, end, up = begin[:-1].tolist(), begin[1:].tolist(), up.tolist()
    seen, low, part = [0] * n, [0] * n, [-1] * n
    held, clock, found = [], 0, 0
    for first in range(n):
        way = [] if seen[first] else [first]
        while way:
            v = way[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                held.append(v)
            if at[v] < end[v]:
                p = up[at[v]]
                at[v] += 1
                if not seen[p]:
                    way.append(p)
                elif part[p] < 0:
                    low[v] = min(low[v], seen[p])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == seen[v]:
                while part[v] < 0:
                    part[held.pop()] = found
                found += 1
    return np.array(part, dtype=np.int64), found


def block_bits(n: int, held: int = BYTES) -> int:
    """Bits of a block, so that the integers of n parts take `held` bytes at most, or 64 if that is less; each takes 36 bytes besides its bits."""
    return max(64, 7 * (held // max(n, 1) - 36))


def counted(order: Order, blocks: Iterable[int], bits: int) -> np.ndarray:
    """How many ancestors of each part lie in the blocks."""
    begin, up, bit, loop, last = (x.tolist() for x in order[2:])
    n, total = len(loop), [0] * len(loop)
    for block in blocks:
        lo, hi = block * bits, (block + 1) * bits
        v, inside, reach, has = bisect_right(bit, lo) - 1, min(bisect_left(bit, hi), n), 0, [0] * n
        while v < inside or v <= reach:
            above = 0
            for p in up[begin[v] : begin[v + 1]]:
                above |= has[p]
            below = above
            if v < inside:
                start, end = max(bit[v], lo) - lo, min(bit[v + 1], hi) - lo
                if start < end:
                    below |= ((1 << end - start) - 1) << start
                    if loop[v]:
                        above = below
            if below:
                total[v] += above.bit_count()
                if last[v]:
                    has[v] = below
                    if last[v] > reach:
                        reach = last[v]
            v += 1
    return np.array(total, dtype=np.int64)


def _rows(order: Order, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    each = total[order.part]
    some = each > 0
    yield from pa.table({"id": pa.array(order.ids[some], pa.int64()), "ancestors": pa.array(each[some], pa.int64())}).to_batches(50_000)


def ancestor_counts(edges: DataFrame, source: str, target: str, most: int = MOST, held: int = BYTES) -> DataFrame:
    """(node, ancestors) for every node that an edge leads to: how many nodes lead to it over one edge or more, itself among them if it is on a loop.

    Edges with a null end do not count, repeated ones once.
    """
    spark = edges.sparkSession
    base = staged(edges.select(edges[source].alias("source"), edges[target].alias("target")).dropna().distinct(), "ancestors-edges")
    names = staged(base.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()), "ancestors-nodes")
    number = lambda df, end, to: df.join(names.select(F.col("node").alias(end), F.col("id").alias(to)), end).drop(end)
    links = number(number(base, "source", "a"), "target", "b")
    if base.count() > most:
        counts = by_component(staged(links, "ancestors-links"), most, held)
    else:
        t = links.toArrow()
        counts = by_block(spark, ordered(t.column("a").to_numpy(), t.column("b").to_numpy()), held)
    return counts.join(names, "id").select("node", "ancestors")


def by_block(spark, order: Order, held: int = BYTES) -> DataFrame:
    """(id, ancestors), the blocks dealt out to tasks in turn."""
    bits = block_bits(len(order.loop), held)
    blocks = -(-int(order.bit[-1]) // bits)
    tasks = max(1, min(blocks, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast(tuple(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [k for b in batches for t in b.column(0).to_pylist() for k in range(t, blocks, tasks)]
        if mine:
            whole = Order(*shared.value)
            yield from _rows(whole, counted(whole, mine, bits))

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, COUNTS).groupBy("id").agg(F.sum("ancestors").alias("ancestors"))


def by_component(links: DataFrame, most: int = MOST, held: int = BYTES) -> DataFrame:
    """(id, ancestors) of edges (a, b) of any number."""
    whose = links.join(components(links), links["a"] == F.col("node"), "left").select("a", "b", F.coalesce("component", "a").alias("component"))
    whose = staged(whose, "ancestors-components")
    busy = whose.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("component")
    small, large = whose.join(busy, "component", "left_anti"), whose.join(busy, "component", "left_semi")

    def flush(edges: pa.Table) -> Iterator[pa.RecordBatch]:
        if edges.num_rows:
            whole = ordered(edges.column("a").to_numpy(), edges.column("b").to_numpy())
            bits = block_bits(len(whole.loop), held)
            yield from _rows(whole, counted(whole, range(-(-int(whole.bit[-1]) // bits)), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in batches:
            waiting, size = [*waiting, b], size + b.num_rows
            if size >= CHUNK:
                t = pa.Table.from_batches(waiting)
                c = t.column("component").to_numpy()
                starts = np.flatnonzero(c[1:] != c[:-1])
                if len(starts):  # the last component may go on in the next batch
                    yield from flush(t.slice(0, int(starts[-1]) + 1))
                    t = t.slice(int(starts[-1]) + 1)
                waiting, size = t.to_batches(), t.num_rows if len(starts) else 0
        if waiting:
            yield from flush(pa.Table.from_batches(waiting))

    counts = small.select("component", "a", "b").repartition("component").sortWithinPartitions("component").mapInArrow(run, COUNTS)
    if busy.isEmpty():
        return counts
    return counts.unionByName(closure(large, "a", "b").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("ancestors")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node but the smallest of each connected component, which names it.

    Large and small stars in turn (Kiveris and others 2014): every node hands its greater neighbours, then its
    smaller ones, to the smallest; each round is written to the shared folder.
    """
    stars = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct(), "stars-0")
    k = 0
    while True:
        k += 1
        both = stars.unionByName(stars.select(F.col("component").alias("node"), F.col("node").alias("component")))
        low = both.groupBy("node").agg(F.least(F.min("component"), "node").alias("low"))
        large = both.join(low, "node").filter("component > node").select(F.col("component").alias("node"), F.col("low").alias("component")).distinct()
        least = large.groupBy("node").agg(F.min("component").alias("low"))
        small = large.join(least, "node").select(F.col("component").alias("node"), F.col("low").alias("component")).filter("node <> component")
        after = staged(small.unionByName(least.withColumnRenamed("low", "component")).distinct(), f"stars-{k}")
        if after.count() == stars.count() and after.join(stars, ["node", "component"], "left_anti").isEmpty():
            return after
        stars = after
