"""Parent-child links of unknown depth to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent. Each round replaces a pointer by the pointer of the node it
points to, so the distance covered doubles and a tree of depth d is resolved after log2(d) rounds; depth and
path are composed on the way. Nodes still unresolved after log2(nodes of the tree's group) rounds are on a
loop or below one: their pointer has then landed on the loop, and the smallest id met from there is its name.

Scale: links never leave a group (here a trace), so one shuffle by group is enough for all groups of up to
`HOT` rows: each task streams whole groups through vectorised doubling over arrays, some `CHUNK` rows at a
time. Groups above `HOT` are kept out of that shuffle and doubled by joins keyed on (group, node), which
spread one huge group over all tasks; each round's table is written to the shared folder, and only
unresolved nodes go on to the next.

Defined results: rows without group or node do not count; repeated rows are one node, with the smallest
parent that isn't null; a parent that is null or not a node of the same group ends the climb (depth 0, the
node is its own root); a node that is its own parent is a loop. Nodes on or below a loop have a null root,
depth and path, and the loop's smallest id as `cycle`; `loose` is 1 for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedlens.common import staged

HOT = 200_000
CHUNK = 100_000
SCHEMA = "entity string, node string, parent string, root string, depth long, cycle string, path string"


def doubled(up: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root index (-1 on or below a loop), depth, and a loop node's index (-1 if none); `up` has -1 for no parent."""
    n = len(up)
    at = np.where(up < 0, np.arange(n), up)
    depth = (up >= 0).astype(np.int64)
    top = up < 0
    live = np.flatnonzero(~top[at])
    for _ in range(int(widest).bit_length() + 1):
        if not len(live):
            break
        via = at[live]
        depth[live] += depth[via]
        at[live] = at[via]
        live = live[~top[at[live]]]
    root = at.copy()
    landed = np.full(n, -1, dtype=np.int64)
    if len(live):
        root[live] = -1
        landed[live] = at[live]
        depth[live] = -1
    return root, depth, landed


def smallest_on_loops(up: np.ndarray, landed: np.ndarray, rank: np.ndarray, widest: int) -> np.ndarray:
    """For each index with a landing node, the rank of the smallest node on its loop; by doubling over loop nodes only."""
    caught = np.flatnonzero(landed >= 0)
    out = np.full(len(up), -1, dtype=np.int64)
    if len(caught):
        low, at = np.full(len(up), np.iinfo(np.int64).max), np.zeros(len(up), dtype=np.int64)
        low[caught], at[caught] = rank[caught], up[caught]
        for _ in range(int(widest).bit_length() + 1):
            step = at[caught]
            low[caught] = np.minimum(low[caught], low[step])
            at[caught] = at[step]
        out[caught] = low[landed[caught]]
    return out


def resolve(entity: np.ndarray, node: np.ndarray, parent: np.ndarray, between: str | None) -> pd.DataFrame:
    """Hierarchy of whole groups; rows may repeat. `entity` must be sorted."""
    group = np.concatenate([[0], np.cumsum(entity[1:] != entity[:-1])]) if len(entity) else np.zeros(0, dtype=np.int64)
    both, names = pd.factorize(np.concatenate([node, parent]), sort=True, use_na_sentinel=True)
    width = np.int64(len(names) + 1)
    own, above = group * width + both[: len(node)], np.where(both[len(node) :] < 0, -1, group * width + both[len(node) :])
    order = np.lexsort((np.where(above < 0, np.iinfo(np.int64).max, above), own))
    first = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])] if len(order) else order
    keys, above = own[first], above[first]
    spot = np.minimum(np.searchsorted(keys, above), max(len(keys) - 1, 0))
    up = np.where((above >= 0) & (keys[spot] == above), spot, -1) if len(keys) else np.zeros(0, dtype=np.int64)
    widest = int(np.bincount(group[first]).max()) if len(first) else 0
    root, depth, landed = doubled(up, widest)
    low = smallest_on_loops(up, landed, np.arange(len(keys)), widest)
    name = node[first]
    pick = lambda i: np.where(i >= 0, name[np.maximum(i, 0)], None) if len(name) else name
    out = pd.DataFrame({"entity": entity[first], "node": name, "parent": pick(up), "root": pick(root), "depth": pd.array(np.where(depth < 0, 0, depth), dtype="Int64"), "cycle": pick(low)})
    out.loc[depth < 0, "depth"] = pd.NA
    out["path"] = joined_paths(name, up, depth, between) if between is not None else None
    return out


def joined_paths(name: np.ndarray, up: np.ndarray, depth: np.ndarray, between: str = "/") -> np.ndarray:
    """Path from the root, by doubling: a segment of 2^k names grows by the segment of the node above it."""
    segment, at = name.astype(object).copy(), up.copy()
    live = np.flatnonzero((at >= 0) & (depth >= 0))
    while len(live):
        via = at[live]
        grown = segment[via] + between + segment[live]
        segment[live], at[live] = grown, at[via]
        live = live[at[live] >= 0]
    return np.where(depth >= 0, segment, None)


def _chunks(between: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("entity", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("root", pa.string()), ("depth", pa.int64()), ("cycle", pa.string()), ("path", pa.string())])

        def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.concat_tables(held)
                e, n, p = (t.column(c).to_numpy() for c in ("entity", "node", "parent"))
                yield from pa.Table.from_pandas(resolve(e, n, p, between), schema=target, preserve_index=False).to_batches(20_000)

        held, size = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            held, size = [*held, t], size + t.num_rows
            if size >= CHUNK:
                whole = pa.concat_tables(held).combine_chunks()
                e = whole.column("entity").to_numpy()
                starts = np.flatnonzero(e[1:] != e[:-1])
                if len(starts):  # the last group may go on in the next batch
                    cut = int(starts[-1]) + 1
                    yield from flush([whole.slice(0, cut)])
                    whole = whole.slice(cut)
                held, size = [whole], whole.num_rows
        yield from flush(held)

    return run


def hierarchy(df: DataFrame, entity: Column, node: Column, parent: Column, paths: bool = True, hot: int = HOT, between: str = "/") -> DataFrame:
    """(entity, node, parent, root, depth, cycle, path) for every node; `path`, ids with `between` between them, is null unless `paths`."""
    joint = between if paths else None
    links = df.select(entity.cast("string").alias("entity"), node.cast("string").alias("node"), parent.cast("string").alias("parent")).filter("entity is not null and node is not null")
    busy = links.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("entity")
    if busy.isEmpty():
        return by_group(links, joint)
    small, large = links.join(busy, "entity", "left_anti"), links.join(busy, "entity", "left_semi")
    return by_group(small, joint).unionByName(by_joins(large, joint))


def by_group(links: DataFrame, between: str | None = "/") -> DataFrame:
    return links.repartition("entity").sortWithinPartitions("entity").mapInArrow(_chunks(between), SCHEMA)


def by_joins(links: DataFrame, between: str | None = "/") -> DataFrame:
    """The same result by joins between rounds, for groups of any size."""
    nodes = links.groupBy("entity", "node").agg(F.min("parent").alias("parent"))
    ids = nodes.select("entity", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(ids, ["entity", "parent"], "left").select("entity", "node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    segment = F.col("node") if between is not None else F.lit(None).cast("string")
    table = staged(linked.select("entity", "node", "parent", F.coalesce("parent", "node").alias("at"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("done"), F.col("node").alias("low"), segment.alias("path")), "hierarchy-0")
    limit = int(table.groupBy("entity").count().agg(F.max("count")).first()[0] or 0).bit_length() + 1
    settled = table.filter("done")
    rounds = 0
    live = table.filter("not done")
    everything = table
    while rounds < limit and not live.isEmpty():
        rounds += 1
        ahead = everything.select("entity", F.col("node").alias("at"), F.col("at").alias("a_at"), F.col("depth").alias("a_depth"), F.col("done").alias("a_done"), F.col("low").alias("a_low"), F.col("path").alias("a_path"))
        moved = live.join(ahead, ["entity", "at"]).select(
            "entity", "node", "parent", F.col("a_at").alias("at"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.col("a_done").alias("done"), F.least("low", "a_low").alias("low"),
            (F.concat("a_path", F.lit(between), "path") if between is not None else F.col("path")).alias("path"),
        )
        moved = staged(moved, f"hierarchy-{rounds}")
        settled = settled.unionByName(moved.filter("done"))
        live = moved.filter("not done")
        everything = settled.unionByName(live)
    # low covers the way of 2^rounds nodes from a node on, so for a node on a loop exactly the loop
    loop = live.select("entity", F.col("node").alias("at"), F.col("low").alias("cycle"))
    lost = live.join(loop, ["entity", "at"]).select("entity", "node", "parent", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), "cycle", F.lit(None).cast("string").alias("path"))
    good = settled.select("entity", "node", "parent", F.col("at").alias("root"), "depth", F.lit(None).cast("string").alias("cycle"), "path")
    return good.unionByName(lost)


def descendants(resolved: DataFrame, *also: str, between: str = "/") -> DataFrame:
    """(entity, ancestor, node, distance, *also) for every node below another, from the paths of `hierarchy` with the same `between`, which no id may hold.

    Nodes on or below loops have no path and so no rows, unless `resolved` comes from `loops_cut`.
    """
    steps = resolved.filter("depth > 0").select("entity", "node", "depth", *also, F.posexplode(F.split("path", re.escape(between))).alias("pos", "ancestor"))
    return steps.filter("pos < depth").select("entity", "ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"), *also)


def loops_cut(resolved: DataFrame, hot: int = HOT, between: str = "/") -> DataFrame:
    """(entity, node, depth, cycle, path) of `hierarchy`, with each loop cut above the node that names it, from which depth and path are counted."""
    caught = staged(resolved.filter("cycle is not null").select("entity", "node", "parent", "cycle"), "loops")
    cut = hierarchy(caught, F.col("entity"), F.col("node"), F.when(F.col("node") != F.col("cycle"), F.col("parent")), hot=hot, between=between)
    trees = resolved.filter("cycle is null").select("entity", "node", "depth", "cycle", "path")
    return trees.unionByName(cut.select("entity", "node", "depth", F.col("root").alias("cycle"), "path"))
