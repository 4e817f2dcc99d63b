"""Percentiles of very large columns per group, mergeable and with a bounded error, by buffer collapsing.

A sketch is a set of sorted buffers of `SIZE` values; a value of a buffer at level l stands for 2^l rows. Two
buffers of a level collapse to one of the next: merge them and take every second position, starting with the
first and the second in turn. A collapse at level l moves a rank by at most 2^l, so adding that up gives a
bound on the rank error that is proven and reported, not estimated. Nothing is random.

Sketches are built in the map tasks, merged in a tree (groups of map tasks first, then everything of a group),
and kept per period: the sketch of several periods is the merge of theirs.

Scale: a map task sends at most `SIZE` values per level and group, and a group of a third of all rows is merged
by `FAN` tasks before the last one sees `FAN` small sketches. With SIZE 2048 the error bound is about
log2(n / 2048) / 4096 of the rows, 0.5 % at two billion rows a group.

Defined results: null, NaN and infinite values do not count; the key columns may be null, null being a key of
its own; a group of at most `SIZE` values is exact; percentile q is the value of rank ceil(q n); every row
counts, repeated or not (drop repeats before if they must not).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, FAN, HELD = 2048, 16, 2_000_000


class Sketch:
    """Full buffers by level, loose values, the number of values and the bound on the rank error so far."""

    def __init__(self, size: int = SIZE):
        self.size, self.n, self.error = size, 0, 0
        self.levels: dict[int, list[np.ndarray]] = defaultdict(list)
        self.loose: list[np.ndarray] = []
        self.held = 0
        self.turn: dict[int, int] = defaultdict(int)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._put(values)

    def _put(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.held += len(values)
        if len(self.loose) > 64:
            self.loose = [np.concatenate(self.loose)]
        if self.held >= self.size:
            every = np.concatenate(self.loose)
            full = len(every) // self.size * self.size
            for part in np.sort(every[:full].reshape(-1, self.size), axis=1):
                self._full(0, part)
            self.loose, self.held = [every[full:]], len(every) - full

    def _full(self, level: int, buffer: np.ndarray) -> None:
        here = self.levels[level]
        here.append(buffer)
        while len(here) >= 2:
            a, b = here.pop(), here.pop()
            start = self.turn[level] = 1 - self.turn[level]
            self.error += 1 << level
            self._full(level + 1, np.sort(np.concatenate([a, b]), kind="stable")[1 - start :: 2])

    def merge(self, level: int, values: np.ndarray) -> None:
        """A buffer of another sketch; its rows and error are to be added by `count`."""
        if level == 0 and len(values) < self.size:
            self._put(values)
        else:
            self._full(level, values)

    def count(self, n: int, error: int) -> None:
        self.n, self.error = self.n + n, self.error + error

    def buffers(self) -> list[tuple[int, np.ndarray]]:
        out = [(level, b) for level, here in sorted(self.levels.items()) for b in here]
        return [*out, *([(0, np.concatenate(self.loose))] if self.held else [])]

    def bound(self) -> int:
        """Largest possible difference between the rank asked for and a rank the answer has."""
        return self.error + max((1 << level for level, here in self.levels.items() if here and level), default=0)

    def at(self, shares: list[float]) -> list[float | None]:
        parts = self.buffers()
        if not parts:
            return [None] * len(shares)
        v = np.concatenate([b for _, b in parts])
        w = np.concatenate([np.full(len(b), 1 << level, dtype=np.int64) for level, b in parts])
        order = np.argsort(v, kind="stable")
        reach = np.cumsum(w[order])
        return [float(v[order][min(np.searchsorted(reach, math.ceil(q * self.n)), len(v) - 1)]) for q in shares]


def _schema(keys: list[T.StructField]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [T.StructField(f.name, f.dataType) for f in keys]
    spark_schema = T.StructType([*keys, T.StructField("salt", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("error", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("values", T.BinaryType())])
    return spark_schema, to_arrow_schema(spark_schema)


def _rows(found: dict[tuple, Sketch], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per buffer; the first of a sketch carries its counts."""
    out: list[tuple] = []
    for key, s in found.items():
        for i, (level, values) in enumerate(s.buffers()):
            out.append((*key, s.n if i == 0 else 0, s.error if i == 0 else 0, level, values.astype(np.float64).tobytes()))
        if len(out) >= 2000:
            yield _batch(out, target)
            out = []
    if out:
        yield _batch(out, target)


def _batch(out: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), target.types, strict=True)], schema=target)


def sketches(df: DataFrame, value: Column, keys: dict[str, Column], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(keys..., salt, n, error, level, values): one sketch per key combination, a row per buffer."""
    rows = df.select(*[c.alias(k) for k, c in keys.items()], value.cast("double").alias("__value"))
    rows = rows.filter("__value is not null and not isnan(__value) and abs(__value) < double('infinity')")
    spark_schema, target = _schema(rows.schema.fields[:-1])
    names = list(keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % fan
        found: dict[tuple, Sketch] = {}
        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, dtype=np.int64)
            words = []
            for k in names:
                d = b.column(k).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy()
                words.append([*d.dictionary.to_pylist(), None])
            v = b.column("__value").to_numpy()
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for part in np.split(order, cuts):
                c, key = int(code[part[0]]), []
                for w in reversed(words):
                    c, i = divmod(c, len(w))
                    key.append(w[i])
                found.setdefault((*reversed(key), salt), Sketch(size)).add(v[part])
            held += len(v)
            if held >= HELD:
                yield from _rows(found, target)
                found, held = {}, 0
        yield from _rows(found, target)

    built = rows.mapInArrow(build, spark_schema)
    if fan > 1:
        built = merged(built, [*names, "salt"], size).withColumn("salt", F.lit(0))
    return merged(built, names, size)


def merged(parts: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per `by` from the buffers of many; the other key columns become null."""
    schema, target = _schema(parts.schema.fields[: parts.columns.index("salt")])
    names = parts.columns[: parts.columns.index("salt") + 1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s in _folded(batches, by, size):
            at = dict(zip(by, key, strict=True))
            yield from _rows({tuple(at.get(k) for k in names): s}, target)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_ = [], 0
        for b in fold(batches):
            held, size_ = [*held, b], size_ + b.num_rows
            if size_ >= 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size_ = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return parts.repartition(*by).sortWithinPartitions(*by, "level", "values").mapInArrow(grouped, schema)


def _folded(batches: Iterator[pa.RecordBatch], by: list[str], size: int) -> Iterator[tuple[tuple, Sketch]]:
    """Sketches of the groups of sorted buffers, one group in memory at a time; buffers of a high level go last."""
    last, s = None, None
    for b in batches:
        keys = zip(*[b.column(k).to_pylist() for k in by], strict=True)
        for key, n, error, level, values in zip(keys, *[b.column(k).to_pylist() for k in ("n", "error", "level", "values")], strict=True):
            if s is None or key != last:
                if s is not None:
                    yield last, s
                last, s = key, Sketch(size)
            s.count(n, error)
            s.merge(level, np.frombuffer(values, dtype=np.float64))
    if s is not None:
        yield last, s


def percentiles(built: DataFrame, by: list[str], shares: dict[str, float], size: int = SIZE) -> DataFrame:
    """(by..., n, each share, max_rank_error) from sketches, merging those of the other keys."""
    kinds = [f for f in built.schema.fields if f.name in by]
    schema = T.StructType([*kinds, T.StructField("n", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in shares], T.StructField("max_rank_error", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    target, order = to_arrow_schema(schema), [f.name for f in kinds]
    asked = list(shares.values())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, s in _folded(batches, order, size):
            out.append((*key, s.n, *s.at(asked), s.bound()))
            if len(out) >= 2000:
                yield _batch(out, target)
                out = []
        if out:
            yield _batch(out, target)

    return built.repartition(*order).sortWithinPartitions(*order, "level", "values").mapInArrow(answer, schema)
