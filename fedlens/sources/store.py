"""The store of one run: JSON documents, append-only record logs, a manifest of hashes, and their verification.

Logs are folders of JSON-lines part files that Spark appends to; documents are small files replaced by
writing beside and renaming. All access goes through the Hadoop file system, so a run folder may lie on any
storage the cluster shares.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import time
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedlens.common import staged
from fedlens.operators import records

#: Files every bundle has (fixed names of the bundle format).
REQUIRED = ["run.json", "graph.json", "spans.ndjson", "events.ndjson", "metrics.ndjson", "datasets/registry.json", "datasets/lineage.json", "datasets/materializations.ndjson", "datasets/registry_updates.ndjson", "datasets/lineage_edges.ndjson"]
LOGS = {"spans.ndjson": records.SPAN, "events.ndjson": records.EVENT, "metrics.ndjson": records.METRIC, "datasets/materializations.ndjson": records.MATERIALIZATION, "datasets/registry_updates.ndjson": records.REGISTRY, "datasets/lineage_edges.ndjson": records.LINEAGE}
SEQ = ", log_batch bigint, log_seq bigint"  # the append a row came with, and its place in it: Spark task << 33, then row
WHOLE = 256 << 20  # files up to this size are hashed in one piece
MANIFEST = "path string, sha256 string, bytes bigint, required boolean"


class StoreError(ValueError):
    pass


def bad_path(path: Column) -> Column:
    """Whether a manifest path is empty, absolute, or has empty, `.` or `..` steps."""
    return path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"^[A-Za-z]:|\\") | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, the first bad one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no) of the lines of `read_ordered_lines` that are no record, blank ones left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    shape = T._parse_datatype_string(f"struct<{schema}, __bad string>")
    return whole.filter("trim(line) <> ''").select("file", (F.col("pos") + 1).alias("line_no"), F.from_json("line", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})["__bad"].alias("bad")).filter("bad is not null").select("file", "line_no")


def read_ordered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of foreign files whose order carries meaning: the rows with `file` and `line_no` from 1. One task reads a file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    parsed = whole.filter("trim(line) <> ''").select("file", (F.col("pos") + 1).alias("line_no"), F.from_json("line", T._parse_datatype_string(schema), {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("file", "line_no", "r.*")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of local files, read piece by piece."""
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            made = hashlib.sha256()
            with open(unquote(re.sub("^file:/*", "/", path)), "rb") as f:
                while piece := f.read(1 << 20):
                    made.update(piece)
            out.append(made.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string()), b.column("length")], ["path", "sha256", "length"])


def files(spark: SparkSession, root: str, whole_up_to: int = WHOLE) -> DataFrame:
    """(path, sha256, bytes) of every file below `root` but temporary ones; hashed where the bytes are read.

    Files above `whole_up_to` bytes are hashed piece by piece, which needs a file system that is mounted (file:).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.load(root).filter(~F.col("path").endswith(".tmp") & ~F.col("path").endswith(".crc"))
    hashed = found.filter(F.col("length") <= whole_up_to).select("path", F.sha2("content", 256).alias("sha256"), "length")
    large = found.filter(F.col("length") > whole_up_to).select("path", "length")
    if not large.isEmpty():
        hashed = hashed.unionByName(large.mapInArrow(_digests, "path string, sha256 string, length long"))
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/*", "/")
    path = F.replace(F.regexp_replace("path", "^file:/*", "/"), base, F.lit(""))
    return hashed.select(path.alias("path"), "sha256", F.col("length").alias("bytes"))


def manifest_problems(listed: DataFrame, found: DataFrame, required: list[str]) -> DataFrame:
    """(path, problem) of a manifest against the files there; files it doesn't list are no problem."""
    spark = listed.sparkSession
    twice = listed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit("duplicate_path").alias("problem"))
    bad = listed.filter(bad_path(F.col("path"))).select("path", F.lit("bad_path").alias("problem"))
    there = found.select("path", F.col("sha256").alias("f_sha"), F.col("bytes").alias("f_bytes"))
    both = listed.filter(~bad_path(F.col("path"))).join(there, "path", "left")
    differs = F.when(F.col("f_sha").isNull() & F.coalesce("required", F.lit(True)), "missing_file").when(F.col("f_bytes") != F.col("bytes"), "size_mismatch").when(F.col("f_sha") != F.lower("sha256"), "hash_mismatch")
    wrong = both.select("path", differs.alias("problem")).filter("problem is not null")
    needed = spark.createDataFrame([(p,) for p in required], "path string")
    # a log is a folder, so a required name counts as listed by any path below it
    covered = listed.select(F.explode(F.array("path", F.regexp_extract("path", r"^(.*\.ndjson)/", 1))).alias("path")).distinct()
    unlisted = needed.join(covered, "path", "left_anti").select("path", F.lit("required_not_listed").alias("problem"))
    return twice.unionByName(bad).unionByName(wrong).unionByName(unlisted)


def placed(log: DataFrame) -> DataFrame:
    """The rows of a log with their `position` from 0 in the order they were added; only one row per append and task is ordered in one place."""
    task = F.shiftrightunsigned("log_seq", 33)
    counts = log.groupBy("log_batch", task.alias("log_task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("log_batch", "log_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("log_batch", "log_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return log.withColumn("log_task", task).join(starts, ["log_batch", "log_task"]).withColumn("position", F.col("start") + F.col("log_seq").bitwiseAND(F.lit((1 << 33) - 1))).drop("log_task", "start")


class Bundle:
    def __init__(self, spark: SparkSession, root: str, refresh: int | None = None):
        """`refresh`: rewrite the manifest after so many appends; None only when asked to."""
        self.spark, self.root, self.refresh = spark, root.rstrip("/"), refresh
        self.writes = 0
        self._batches: dict[str, int] = {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # documents
    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def write(self, name: str, document: object) -> None:
        self.write_pieces(name, [json.dumps(document, indent=2, sort_keys=True)])

    def write_pieces(self, name: str, pieces: Iterable[str]) -> None:
        """Replace a document by the pieces of its text, written beside it and then renamed."""
        target, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.tmp")
        out = self._fs.create(beside, True)
        try:
            for piece in pieces:
                out.write(bytearray(piece.encode()))
        finally:
            out.close()
        self._fs.delete(target, False)
        if not self._fs.rename(beside, target):
            raise StoreError(f"could not replace {name}")

    def sha256(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, name: str) -> object:
        return json.loads(self.text(name))

    # life
    @classmethod
    def create(cls, spark: SparkSession, base: str, run_id: str, **k) -> Bundle:
        if not re.fullmatch("[0-9a-f]{32}", run_id) or not run_id.strip("0"):
            raise StoreError("invalid_run_id")
        b = cls(spark, f"{base.rstrip('/')}/{run_id}", **k)
        if b.exists(""):
            raise StoreError("run exists")
        b.write("run.json", {"schema_version": 1, "run_id": run_id, "created_unix_nanos": time.time_ns()})
        b.write("graph.json", {"graph_id": run_id, "nodes": [], "edges": []})
        b.write("datasets/registry.json", {"schema_version": 1, "datasets": []})
        b.write("datasets/lineage.json", {"schema_version": 1, "edges": []})
        for name in LOGS:
            b._fs.mkdirs(b._path(f"{b.root}/{name}"))
            out = b._fs.create(b._path(f"{b.root}/{name}/part-empty.json"), True)
            out.write(10)  # a blank line: files of no length are not listed
            out.close()
        b.finalize()
        return b

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Bundle:
        b = cls(spark, root)
        b.read("run.json")
        return b

    # logs
    def _next_batch(self, name: str) -> int:
        """A number above those of all earlier appends to a log, of this process or of others."""
        if name not in self._batches:
            self._batches[name] = self.log(name).agg(F.max("log_batch")).first()[0] or 0
        self._batches[name] = max(self._batches[name] + 1, time.time_ns())
        return self._batches[name]

    def append(self, name: str, rows: DataFrame | list[dict]) -> None:
        """Add rows to a log, after all that were there before; rows out of bounds fail before anything is written."""
        schema = LOGS[name] + SEQ
        batch = self._next_batch(name)
        if isinstance(rows, list):
            full = T._parse_datatype_string(schema)
            rows = self.spark.createDataFrame([{**{f: None for f in full.names}, **r, "log_batch": batch, "log_seq": i} for i, r in enumerate(rows)], full)
        else:
            rows = rows.withColumns({"log_batch": F.lit(batch), "log_seq": F.monotonically_increasing_id()})
        kind = {"spans.ndjson": "span", "events.ndjson": "event", "metrics.ndjson": "metric"}.get(name)
        if kind:
            first = rows.select(records.record_error(kind).alias("e")).filter("e is not null").first()
            if first:
                raise StoreError(first["e"])
        empty = [F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType) else F.col(f.name) for f in rows.schema.fields]
        rows.select(*empty).write.mode("append").option("ignoreNullFields", True).json(f"{self.root}/{name}")
        self.writes += 1
        if self.refresh is not None and self.writes % max(1, self.refresh) == 0:
            self.finalize()

    def append_all(self, logs: dict[str, list[dict]]) -> None:
        """Add rows to several logs, or to none: what was written before a write failed is taken out again."""
        before = {name: {f.getPath().getName() for f in self._listed(name)} for name in logs}
        try:
            for name, rows in logs.items():
                if rows:
                    self.append(name, rows)
        except Exception:
            for name, had in before.items():
                for f in self._listed(name):
                    if f.getPath().getName() not in had:
                        self._fs.delete(f.getPath(), True)
            raise

    def _listed(self, name: str) -> list:
        where = self._path(f"{self.root}/{name}")
        return list(self._fs.listStatus(where)) if self._fs.exists(where) else []

    def log(self, name: str) -> DataFrame:
        schema = LOGS[name] + SEQ
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return read_lines(self.spark, f"{self.root}/{name}", schema)

    # manifest
    def finalize(self) -> None:
        missing = [p for p in REQUIRED if not self.exists(p)]
        if missing:
            raise StoreError(f"missing required file: {missing[0]}")
        rows = files(self.spark, self.root).filter("path <> 'manifest.json'").orderBy("path").collect()  # a row per file of one run
        needed = lambda p: p in REQUIRED or any(p.startswith(f"{r}/") for r in REQUIRED)
        self.write("manifest.json", {"schema_version": 1, "entries": [{"path": r["path"], "sha256": r["sha256"], "bytes": r["bytes"], "required": needed(r["path"])} for r in rows]})

    def escapes(self, paths: list[str]) -> list[str]:
        """Of the paths below the root of a mounted file system, those that links lead out of it."""
        if self._fs.getScheme() != "file":
            return []
        top = os.path.realpath(re.sub("^file:/*", "/", self.root))
        inside = lambda p: os.path.realpath(os.path.join(top, p)).startswith(top + os.sep)
        return [p for p in paths if p and not os.path.isabs(p) and not inside(p)]

    def problems(self) -> list[tuple[str, str]]:
        entries = [(e["path"], e["sha256"], e["bytes"], e["required"]) for e in self.read("manifest.json")["entries"]]
        listed = self.spark.createDataFrame(entries, MANIFEST)
        found = set(map(tuple, manifest_problems(listed, files(self.spark, self.root), REQUIRED).collect()))  # metadata of one run
        return sorted(found | {(p, "bad_path") for p in self.escapes([e[0] for e in entries])})

    # snapshots
    def snapshot(self) -> None:
        """Write the folded registry and lineage, and last the marker that both belong together."""
        for name, field, df in (("registry", "datasets", self.registry()), ("lineage", "edges", self.lineage())):
            rows = (r[0] for r in staged(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), f"snapshot-{name}").toLocalIterator())  # a part at a time
            lines = ((", " if i else "") + row + "\n" for i, row in enumerate(rows))
            self.write_pieces(f"datasets/{name}.json", itertools.chain([f'{{"schema_version": 1, "{field}": ['], lines, ["]}"]))
        self.write("datasets/snapshot_pair_commit.json", {"schema_version": 1, "registry_sha256": self.sha256("datasets/registry.json"), "lineage_sha256": self.sha256("datasets/lineage.json")})

    def snapshot_warning(self) -> str | None:
        """Why the snapshots must not be used and the logs alone count, or null."""
        if not self.exists("datasets/snapshot_pair_commit.json"):
            return None
        marker = self.read("datasets/snapshot_pair_commit.json")
        if marker.get("schema_version") != 1:
            return f"unsupported snapshot marker version {marker.get('schema_version')}"
        if (marker["registry_sha256"], marker["lineage_sha256"]) != (self.sha256("datasets/registry.json"), self.sha256("datasets/lineage.json")):
            return "snapshot pair does not match its marker; the logs are replayed"
        return None

    def _with_snapshot(self, name: str, field: str, schema: str, log: str) -> DataFrame:
        old = read_document(self.spark, f"{self.root}/datasets/{name}.json", f"schema_version int, {field} array<struct<{schema}>>").select(F.explode(field).alias("r")).select("r.*")
        old = old.filter(F.lit(not self.snapshot_warning()))
        return old.withColumns({"log_batch": F.lit(-1).cast("long"), "log_seq": F.lit(-1).cast("long")}).unionByName(self.log(log))

    def registry(self) -> DataFrame:
        every = self._with_snapshot("registry", "datasets", records.REGISTRY, "datasets/registry_updates.ndjson")
        return records.latest(every, ["asset_key"], ["log_batch", "log_seq"]).drop("log_batch", "log_seq").orderBy("asset_key")

    def lineage(self) -> DataFrame:
        return records.lineage_edges(self._with_snapshot("lineage", "edges", records.LINEAGE, "datasets/lineage_edges.ndjson").drop("log_batch", "log_seq"))

    def materializations(self) -> DataFrame:
        """All materialisations as V2, in order of ts_unix_nanos and record_seq."""
        return records.to_v2(placed(self.log("datasets/materializations.ndjson")), F.col("position")).orderBy("ts_unix_nanos", "record_seq")


class Emitter:
    """Where records of a run go: subclass it for another place than a bundle; rows are a DataFrame or a list of dicts."""

    def emit(self, log: str, rows: DataFrame | list[dict]) -> None:
        raise NotImplementedError

    def spans(self, rows: DataFrame | list[dict]) -> None:
        self.emit("spans.ndjson", rows)

    def events(self, rows: DataFrame | list[dict]) -> None:
        self.emit("events.ndjson", rows)

    def metrics(self, rows: DataFrame | list[dict]) -> None:
        self.emit("metrics.ndjson", rows)


class BundleEmitter(Emitter):
    """Into the logs of a bundle, which checks their bounds."""

    def __init__(self, bundle: Bundle):
        self.bundle = bundle

    def emit(self, log: str, rows: DataFrame | list[dict]) -> None:
        self.bundle.append(log, rows)
