"""Records of a run: bounds, versions, folding of change logs, durations and the joint timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedlens.functions.identity import joined, shown, valid_id

NAME_BYTES, ATTRS, ATTR_KEY_BYTES, ATTR_VALUE_BYTES, UNIT_BYTES = 256, 64, 128, 1024, 64

SPAN = "schema_version int, trace_id string, span_id string, parent_span_id string, name string, start_unix_nanos bigint, end_unix_nanos bigint, attrs map<string,string>"
EVENT = "schema_version int, ts_unix_nanos bigint, trace_id string, span_id string, name string, attrs map<string,string>"
METRIC = EVENT + ", value double, unit string"
AUDIT = "struct<transform_name:string,core_trusted:boolean,round_id:bigint>"
MATERIALIZATION_V1 = "schema_version int, ts_unix_nanos bigint, asset_key string, fingerprint_v0 string, node_id string, node_def_hash string, rows bigint, bytes bigint, cache_hit boolean, duration_ms bigint"
MATERIALIZATION = (
    "schema_version int, record_seq bigint, ts_unix_nanos bigint, asset_key string, fingerprint_v0 string, node_id string, node_def_hash string, op_type string, input_asset_keys array<string>, "
    "input_fingerprints_v0 array<string>, rows bigint, bytes bigint, duration_ms bigint, cache_decision string, cache_reason string, cache_key_v0 string, cache_hit boolean, unsafe_surface boolean, "
    f"unsafe_reasons array<string>, applied_transforms array<{AUDIT}>, status string, error_code string, quality struct<null_rate:double,row_count_delta:bigint,schema_changed:boolean>"
)
REGISTRY = (
    "asset_key string, fingerprint_v0 string, source_fingerprint_v0 string, schema_hash_v0 string, recipe_hash_v0 string, trust string, source struct<uri:string,content_type:string,auth_mode:string,etag_or_version:string>, "
    "schema struct<format:string,canonical:string>, license_flags array<string>, pii_tags array<string>"
)
LINEAGE = "input_fingerprint_v0 string, output_fingerprint_v0 string, node_id string, op_kind string"


def record_error(kind: str) -> Column:
    """Why a span, event or metric record is out of bounds (sizes in bytes), or null; the first failure counts."""
    attrs = F.col("attrs")
    checks = [(~valid_id(F.col("trace_id"), 32), "invalid_trace_id"), (~valid_id(F.col("span_id"), 16), "invalid_span_id")] if kind == "span" else []
    checks += [
        (F.octet_length("name") > NAME_BYTES, "name_too_long"),
        (F.size(F.map_keys(attrs)) > ATTRS, "too_many_attrs"),
        (F.exists(F.map_keys(attrs), lambda k: F.octet_length(k) > ATTR_KEY_BYTES), "attr_key_too_long"),
        (F.exists(F.map_values(attrs), lambda v: F.octet_length(v) > ATTR_VALUE_BYTES), "attr_value_too_long"),
    ]
    if kind == "metric":
        checks.append((F.octet_length("unit") > UNIT_BYTES, "unit_too_long"))
    return F.coalesce(*[F.when(bad, reason) for bad, reason in checks])


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, null if the end is missing or before the start."""
    return F.when(end >= start, F.floor((end - start) / F.lit(1_000_000))).cast("long")


def quick_duration_ms(start: Column, finish: Column) -> Column:
    """Whole milliseconds of a clock that may step back: never below 0."""
    return F.floor(F.greatest(F.lit(0), finish - start) / F.lit(1_000_000)).cast("long")


def latest(changes: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """A change log folded: the last row of each key. Aggregates in the map tasks; ties by the whole row."""
    rest = [c for c in changes.columns if c not in key]
    picked = changes.groupBy(*key).agg(F.max(F.struct(*seq, *[c for c in rest if c not in seq])).alias("__row"))
    return picked.select(*key, *[F.col("__row")[c].alias(c) for c in rest])


def lineage_edges(edges: DataFrame) -> DataFrame:
    """Distinct (input, output, node) with one op_kind."""
    return edges.groupBy("input_fingerprint_v0", "output_fingerprint_v0", "node_id").agg(F.max("op_kind").alias("op_kind"))


def cache_decision(hit: Column) -> Column:
    return F.when(hit, "hit").when(~hit, "miss").otherwise("unknown")


def cache_hit(decision: Column) -> Column:
    return decision == "hit"


def to_v2(mixed: DataFrame, position: Column) -> DataFrame:
    """Rows of either version, read with the V2 schema, as V2: a row without record_seq is V1, of unknown type, unsafe and without provenance."""
    old = F.col("record_seq").isNull()
    none = F.array().cast("array<string>")
    return mixed.select(
        F.lit(2).alias("schema_version"), F.coalesce("record_seq", position + 1).cast("long").alias("record_seq"), "ts_unix_nanos", "asset_key", "fingerprint_v0", "node_id", "node_def_hash", F.when(old, "unknown").otherwise(F.col("op_type")).alias("op_type"),
        F.coalesce("input_asset_keys", none).alias("input_asset_keys"), F.coalesce("input_fingerprints_v0", none).alias("input_fingerprints_v0"), "rows", "bytes", "duration_ms",
        F.coalesce("cache_decision", cache_decision(F.col("cache_hit"))).alias("cache_decision"), "cache_reason", "cache_key_v0", F.coalesce("cache_hit", cache_hit(F.col("cache_decision"))).alias("cache_hit"),
        F.when(old, F.lit(True)).otherwise(F.coalesce("unsafe_surface", F.lit(False))).alias("unsafe_surface"), F.when(old, F.array(F.lit("missing_provenance"))).otherwise(F.coalesce("unsafe_reasons", none)).alias("unsafe_reasons"),
        F.coalesce("applied_transforms", F.array().cast(f"array<{AUDIT}>")).alias("applied_transforms"), F.coalesce("status", F.lit("ok")).alias("status"), "error_code", "quality",
    )


def timeline(spans: DataFrame | None = None, events: DataFrame | None = None, metrics: DataFrame | None = None, materializations: DataFrame | None = None) -> DataFrame:
    """(ts, kind, name, detail) of all records; order by ts, kind, name and detail to have one order."""
    parts = []
    if events is not None:
        parts.append(events.select(F.col("ts_unix_nanos").alias("ts"), F.lit("event").alias("kind"), "name", F.concat(F.lit("span="), shown(F.col("span_id"))).alias("detail")))
    if metrics is not None:
        parts.append(metrics.select(F.col("ts_unix_nanos").alias("ts"), F.lit("metric").alias("kind"), "name", F.concat(F.lit("unit="), shown(F.col("unit"))).alias("detail")))
    if spans is not None:
        parts.append(spans.select(F.col("start_unix_nanos").alias("ts"), F.lit("span").alias("kind"), "name", F.concat(F.lit("duration_ms="), shown(duration_ms(F.col("start_unix_nanos"), F.col("end_unix_nanos")))).alias("detail")))
    if materializations is not None:
        detail = F.concat(F.lit("rows="), shown(F.col("rows")), F.lit(" bytes="), shown(F.col("bytes")), F.lit(" unsafe="), joined(F.col("unsafe_reasons")), F.lit(" status="), shown(F.col("status")))
        parts.append(materializations.select(F.col("ts_unix_nanos").alias("ts"), F.lit("materialization").alias("kind"), F.col("asset_key").alias("name"), detail.alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def quality(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., rows, null_rate): the share of nulls among all values of `columns`."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), (F.sum(nulls) / (F.count(F.lit(1)) * len(columns))).alias("null_rate"))


def quality_changes(history: DataFrame, key: str, seq: str) -> DataFrame:
    """Per record of a dataset: the change in rows and whether its schema hash differs from the one before."""
    w = Window.partitionBy(key).orderBy(seq)
    return history.select(key, seq, (F.col("rows") - F.lag("rows").over(w)).alias("row_count_delta"), (F.col("schema_hash_v0") != F.lag("schema_hash_v0").over(w)).alias("schema_changed"))


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by..., bucket, n, total): bucket k holds values above k of the bounds and not above the next."""
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value)))
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def counters(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, total) of values that add up."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def gauges(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """(by..., at, value): the last value, of several at one instant the largest."""
    last = df.groupBy(*by).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).alias("__last"))
    return last.select(*by, "__last.at", "__last.value")


def attr(attrs: Column, name: str, kind: str = "string") -> Column:
    """A value of an attribute map as the type asked for, null if it isn't one."""
    return F.try_element_at(attrs, F.lit(name)).try_cast(kind)


def ordered_map(pairs: Column) -> Column:
    """A map from an array of (key, value), in order of the keys."""
    return F.map_from_entries(F.array_sort(pairs))


def value_kind(variant: Column) -> Column:
    """The kind of an untagged JSON value: null, bool, int, float, string, array or object."""
    d = F.schema_of_variant(variant)
    return F.when(d == "VOID", "null").when(d == "BOOLEAN", "bool").when(d == "BIGINT", "int").when(d == "STRING", "string").when(d.startswith("ARRAY"), "array").when(d.startswith("OBJECT"), "object").otherwise("float")
