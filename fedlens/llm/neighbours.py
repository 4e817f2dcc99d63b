"""Most similar vectors for every vector, by additive quantisation.

Codebooks are trained on at most `SAMPLE` rows (those of smallest id hash; a documented bound). Every vector
is then encoded by beam search as a sum of full-dimensional codebook entries, with the norm of that sum
stored, and put on the list of its nearest coarse direction. The number of lists grows as the square root of
the rows. A query reads the lists of its nearest directions, scores their codes by adding lookup-table entries,
and the best of each list, at least `LEAST_SHORT`, are reranked by exact cosine.

How many lists are read is measured, not assumed: the true neighbours, of the cosine asked for, of `ASKED`
sampled vectors are found by brute force in one scan, and as many lists are read as hold `TARGET` of them, at
least `PROBES`. Pairs that are nearly alike share the nearest lists, so few are read; where neighbours are
hardly nearer than any other vector, as among random directions, no index can leave much out, about half of
the lists are read, and work grows with the square of the rows.

Scale: one shuffle for the index, one for the queries' probes. Lists are laid into slots of up to `CAP` rows,
longer ones cut over several, so no task holds more than `CAP` index rows; queries stream past them, one row
per query and slot. Vectors of the same direction (to 5 decimals) are one class with one representative in the
index, so a group of copies costs one entry; its members are put back at the end, at most k+1 per class.

Defined results: vectors that are null, of another length, zero or with a null, NaN or infinite value take
no part; rows with the same id are one vector; ties go to the smaller id; fewer than k others give fewer rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedlens.common import staged
from fedlens.llm import additive
from fedlens.llm.sampling import bounded_sample

SAMPLE, STAGES, ENTRIES, BEAM = 20_000, 16, 256, 4
PROBES, CAP, SHORT, LEAST_SHORT = 16, 8192, 32, 8
ASKED, TARGET = 1000, 0.97
EXHAUSTIVE_BLOCK, EXHAUSTIVE_SHORT = 50_000, 400
PART = pa.schema([("query", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])


def comparable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, g) of the rows that take part, but for zero vectors."""
    c = lambda n: df[f"`{n}`"]
    rows = df.select(c(id_col).cast("long").alias("id"), c(vec_col).cast("array<float>").alias("g"))
    return rows.filter(f"id is not null and size(g) = {dim} and not exists(g, x -> x is null or isnan(x) or abs(x) = float('inf'))")


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = g.astype(np.float64)
    size = np.linalg.norm(g, axis=1)
    keep = size > 0
    return (g[keep] / size[keep, None]), keep


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    n, width = len(x), x.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(x)]).cast(pa.binary())


def _vectors(column: pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def classes(rows: DataFrame, dim: int) -> DataFrame:
    """(id, cls, v): the unit vector as bytes and a digest of its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit, keep = _units(_flat(b.column("g"), dim))
                rounded = np.round(unit * 1e5).astype(np.int32)
                names = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rounded]
                yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep)), pa.array(names, pa.binary()), _binary(unit.astype(np.float32))], ["id", "cls", "v"])

    return rows.mapInArrow(run, "id long, cls binary, v binary")


def fit(rows: DataFrame, dim: int, sample: int = SAMPLE, stages: int = STAGES) -> additive.Codebooks | None:
    total = rows.count()
    taken = bounded_sample(rows, total, "id", sample).toArrow()
    if not taken.num_rows:
        return None
    unit, _ = _units(_flat(taken.column("g").combine_chunks(), dim))
    if not len(unit):
        return None
    cells = 1 << max(0, round(math.log2(max(1.0, math.sqrt(total)))))
    return additive.train(unit.astype(np.float32), min(cells, 4096), stages, ENTRIES)


def index(reps: DataFrame, codebooks: additive.Codebooks, dim: int) -> DataFrame:
    """(rep, v, cls, last, cell, codes, norm) of every representative."""
    shared = reps.sparkSession.sparkContext.broadcast((codebooks.cells, codebooks.books))  # its size is fixed by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, books = shared.value
        for b in batches:
            if b.num_rows:
                v = _vectors(b.column("v"), dim)
                near = (v @ cells.T).argmax(1).astype(np.int32)
                codes = additive.encode(v, books, BEAM)
                norm = np.linalg.norm(additive.decode(codes, books), axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("rep", "v", "cls", "last")], pa.array(near), _binary(codes), pa.array(norm.astype(np.float32))], ["rep", "v", "cls", "last", "cell", "codes", "norm"])

    return reps.mapInArrow(run, "rep long, v binary, cls binary, last long, cell int, codes binary, norm float")


def scan(slots: DataFrame, books: np.ndarray | None, dim: int, k: int, short: int, least: float) -> DataFrame:
    """(query, other, cosine): within each slot, the k best rows of at least `least` for each query; without `books` by exact cosine alone.

    `slots` has (slot, kind, rep, v, cell, codes, norm, lists), kind 0 for index rows and 1 for queries; a query reads
    the rows of its `lists`, or all of the slot where that is null.
    """
    shared = slots.sparkSession.sparkContext.broadcast(books)

    def answer(names: np.ndarray, v: np.ndarray, cell: np.ndarray, codes: np.ndarray, norms: np.ndarray, q_names: np.ndarray, q: np.ndarray, lists: pa.Array) -> Iterator[pa.RecordBatch]:
        whole = lists.null_count == len(lists)
        starts = np.zeros(1, dtype=np.int64) if whole else np.unique(cell, return_index=True)[1]  # rows are in the order of their lists
        ends = np.append(starts[1:], len(v))
        by_name = np.argsort(names, kind="stable")
        width = max(1, min(256 if whole else 1024, 4_000_000 // int((ends - starts).max())))
        for i in range(0, len(q), width):
            own, part = q_names[i : i + width], q[i : i + width]
            lut = None if shared.value is None else additive.tables(part, shared.value)
            spot = by_name[np.minimum(np.searchsorted(names, own, sorter=by_name), len(names) - 1)]
            spot = np.where(names[spot] == own, spot, -1)  # where the query itself lies
            best, found = np.full((len(own), k), -9, dtype=np.float32), np.zeros((len(own), k), dtype=np.int64)
            reads = np.ones((len(own), 1), dtype=bool)
            if not whole:
                asked = lists.slice(i, len(own))
                reads = np.zeros((len(own), len(starts)), dtype=bool)
                reads[np.repeat(np.arange(len(own)), asked.value_lengths().to_numpy()), np.searchsorted(cell[starts], asked.flatten().to_numpy())] = True
            for s, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
                who = np.flatnonzero(reads[:, s])
                if not len(who):
                    continue
                rough = part[who] @ v[lo:hi].T if lut is None else additive.score(lut[who], codes[lo:hi], norms[lo:hi])
                mine = np.flatnonzero((spot[who] >= lo) & (spot[who] < hi))
                rough[mine, spot[who][mine] - lo] = -9
                picked = additive.shortlist(rough, short if whole else max(LEAST_SHORT, -(-4 * short * (hi - lo) // len(v))))
                exact = np.einsum("qd,qrd->qr", part[who], v[lo:hi][picked])
                exact[np.take_along_axis(rough, picked, 1) == -9] = -9
                both, other = np.concatenate([best[who], exact], axis=1), np.concatenate([found[who], names[lo:hi][picked]], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best[who], found[who] = np.take_along_axis(both, order, 1), np.take_along_axis(other, order, 1)
            good = best >= max(least, -2)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, good.sum(1))), pa.array(found[good]), pa.array(best[good].astype(np.float64))], schema=PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            s, kind = b.column("slot").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero((s[1:] != s[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(s)], strict=True):
                if s[lo] != slot:
                    slot, held, ready = s[lo], [], None
                part = b.slice(lo, hi - lo)
                names, v = part.column("rep").to_numpy(), _vectors(part.column("v"), dim)
                if kind[lo] == 0:
                    width = 0 if shared.value is None else len(shared.value)
                    codes = _vectors(part.column("codes"), width, np.uint8) if width else np.zeros((len(v), 0), np.uint8)
                    held.append((names, v, part.column("cell").to_numpy(), codes, part.column("norm").to_numpy(zero_copy_only=False)))
                elif held or ready:
                    if not ready:
                        ready = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                        order = np.argsort(ready[2], kind="stable")
                        ready = tuple(x[order] for x in ready)
                    yield from answer(*ready, names, v, part.column("lists"))

    return slots.mapInArrow(run, "query long, other long, cosine double")


def lists_needed(indexed: DataFrame, codebooks: additive.Codebooks, dim: int, k: int, least: float, asked: int = ASKED, target: float = TARGET) -> int:
    """How many lists hold `target` of the true k nearest, of cosine `least` or more, of sampled vectors, by brute force over all rows in one scan."""
    total = indexed.count()
    taken = bounded_sample(indexed.select("rep", "v"), total, "rep", asked).toArrow()
    if not taken.num_rows:
        return PROBES
    names, q = taken.column("rep").to_numpy(), _vectors(taken.column("v"), dim)
    shared = indexed.sparkSession.sparkContext.broadcast((names, q))  # `asked` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        cos, cell = np.full((len(q), k), -9, dtype=np.float32), np.full((len(q), k), -1, dtype=np.int32)
        for b in batches:
            rep, v = b.column("rep").to_numpy(), _vectors(b.column("v"), dim)
            for lo in range(0, len(rep), 4096):
                near = q @ v[lo : lo + 4096].T
                near[names[:, None] == rep[None, lo : lo + 4096]] = -9
                both = np.concatenate([cos, near], axis=1)
                cells = np.concatenate([cell, np.broadcast_to(b.column("cell").to_numpy()[lo : lo + 4096], near.shape)], axis=1)
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                cos, cell = np.take_along_axis(both, best, 1), np.take_along_axis(cells, best, 1)
        at, place = np.nonzero(cos >= max(least, -2))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cos[at, place].astype(np.float64)), pa.array(cell[at, place])], ["query", "cosine", "cell"])

    found = indexed.select("rep", "v", "cell").mapInArrow(run, "query long, cosine double, cell int")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "cell")
    true = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query", "cell").toArrow()  # at most k for each of those asked
    if not true.num_rows:
        return PROBES
    order = np.argsort(-(q @ codebooks.cells.T), axis=1)
    rank = np.argsort(order, axis=1)[true.column("query").to_numpy(), true.column("cell").to_numpy()]
    return max(PROBES, int(np.quantile(rank, target, method="higher")) + 1)


def _scanned(index_rows: DataFrame, query_rows: DataFrame, slots: int, *args) -> DataFrame:
    """`slots`: how many there are, numbered from 0; each is a partition of its own."""
    held = index_rows.select("slot", F.lit(0).alias("kind"), "rep", "v", "cell", "codes", "norm", F.lit(None).cast("array<int>").alias("lists"))
    asks = query_rows.select("slot", F.lit(1).alias("kind"), "rep", "v", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"), "lists")
    return scan(held.unionByName(asks).repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot", "kind"), *args)


def laid_out(sizes: dict[int, int], lists: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot of each list and how many it has: neighbouring lists share one of up to `cap` rows, a longer list has several, an empty one none."""
    first, blocks, slots, room = np.zeros(lists, dtype=np.int64), np.zeros(lists, dtype=np.int64), 0, 0
    for cell, n in sorted(sizes.items()):
        if n > room:
            blocks[cell], first[cell] = -(-n // cap), slots
            slots, room = slots + int(blocks[cell]), cap - n if n <= cap else 0
        else:
            blocks[cell], first[cell], room = 1, slots - 1, room - n
    return first, blocks


def asks(asked: DataFrame, cells: np.ndarray, first: np.ndarray, blocks: np.ndarray, dim: int, probes: int) -> DataFrame:
    """(slot, rep, v, lists): a row for each slot that holds rows of lists the query reads."""
    shared = asked.sparkSession.sparkContext.broadcast((cells, first, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, first, blocks = shared.value
        step = max(1, min(1024, 20_000 // max(1, int((first + blocks).max()))))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                near = np.argsort(-(_vectors(b.column("v"), dim) @ cells.T), axis=1)[:, :probes]
                times = blocks[near.ravel()]
                row, cell = np.repeat(np.repeat(np.arange(b.num_rows), near.shape[1]), times), np.repeat(near.ravel(), times)
                slot = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((slot, row))
                row, cell, slot = row[order], cell[order], slot[order]
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), dtype=bool), (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                at = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(slot[new]), b.column("rep").take(at), b.column("v").take(at), lists], ["slot", "rep", "v", "lists"])

    return asked.select("rep", "v").mapInArrow(run, "slot long, rep long, v binary, lists array<int>")


def probed(indexed: DataFrame, asked: DataFrame, codebooks: additive.Codebooks, dim: int, k: int, least: float, probes: int | None = None, cap: int = CAP, short: int | None = None) -> DataFrame:
    """The representatives `asked` against the lists they read."""
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # a row per list
    first, blocks = laid_out(sizes, len(codebooks.cells), cap)
    slots = max(1, int((first + blocks).max()))
    places = indexed.sparkSession.createDataFrame([(c, int(first[c]), int(blocks[c])) for c in sizes], "cell int, first long, blocks long")
    rows = indexed.join(F.broadcast(places), "cell").withColumn("slot", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    short = short or max(SHORT, -(-EXHAUSTIVE_SHORT // slots))
    probes = min(probes or lists_needed(indexed, codebooks, dim, k, least), len(codebooks.cells))
    return _scanned(rows, asks(asked, codebooks.cells, first, blocks, dim, probes), slots, codebooks.books, dim, k, short, least)


def exhaustive(indexed: DataFrame, asked: DataFrame, books: np.ndarray | None, dim: int, k: int, short: int = EXHAUSTIVE_SHORT, block: int = EXHAUSTIVE_BLOCK) -> DataFrame:
    """A stated query set against every row, in blocks of index rows; `books` None: by brute force."""
    blocks = max(1, -(-indexed.count() // block))
    rows = indexed.withColumn("slot", F.pmod(F.xxhash64("rep"), F.lit(blocks)))
    every = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("lists", F.lit(None).cast("array<int>"))
    return _scanned(rows, every, blocks, books, dim, k, short, -2.0)


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar(df: DataFrame, id_col: str = "id", vec_col: str = "vec", dim: int = 64, k: int = 5, least: float = -2.0, queries: str | None = None, exact: bool = False, through_index: bool = False, probes: int | None = None, cap: int = CAP, short: int | None = None) -> DataFrame:
    """(query, other, cosine): the k most similar others of each vector, of cosine `least` or more.

    `queries`, a condition on the id by the name of `rep`, asks for those vectors only, against all rows; `exact` by brute force, and
    `through_index` as without `queries`, in the lists alone (to measure recall).
    """
    spark = df.sparkSession
    rows = comparable(df, id_col, vec_col, dim)
    codebooks = fit(rows, dim)
    if codebooks is None:
        return spark.createDataFrame([], "query long, other long, cosine double")
    named = classes(rows, dim)
    reps = named.groupBy("cls").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.max("id").alias("last"))
    kept = staged(index(reps.select("rep", "v", "cls", "last"), codebooks, dim), "neighbours-index")
    asked = kept
    if queries is not None:  # every class with a member that is asked for, whichever id represents it
        asked = kept.join(named.select("cls", F.col("id").alias("rep")).filter(queries).select("cls").distinct(), "cls", "left_semi")
    if queries is None or through_index:
        near = probed(kept, asked, codebooks, dim, k, least, probes, cap, short)
    else:
        near = exhaustive(kept, asked, None if exact else codebooks.books, dim, k, short or EXHAUSTIVE_SHORT)
    near = best(near, k)
    shared = kept.filter("last > rep").select("cls", "rep")
    members = staged(named.select("cls", "id").join(shared, "cls").select("rep", "id").distinct(), "neighbours-members")
    rows = with_members(near, members, k).filter(F.col("cosine") >= least)
    return rows if queries is None else rows.withColumn("rep", F.col("query")).filter(queries).drop("rep")


def with_members(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Put the members (rep, id) of classes back: (query, other, cosine) over ids from pairs of representatives.

    A member of a class has the others of its class first. Only the k+1 smallest ids of a class can be
    anyone's neighbours, and a class of more than k members needs no other class.
    """
    w = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    outside = near.join(heads.select(F.col("rep").alias("other"), F.col("id").alias("member")), "other", "left").select("query", F.coalesce("member", "other").alias("other"), "cosine")
    outside = outside.join(heads.groupBy("rep").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("rep", "query"), "query", "left").withColumn("room", F.lit(k + 1) - F.coalesce("size", F.lit(1)))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    outside = outside.filter("room > 0").withColumn("rank", F.row_number().over(order)).filter("rank <= room")
    outside = outside.join(heads.select(F.col("rep").alias("query"), F.col("id").alias("member")), "query", "left").select(F.coalesce("member", "query").alias("query"), "other", "cosine")
    inside = members.join(heads.withColumnRenamed("id", "other"), "rep").filter("id <> other").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("other"))).filter(F.col("rank") <= k)
    return outside.unionByName(inside.select(F.col("id").alias("query"), "other", F.lit(1.0).alias("cosine")))
