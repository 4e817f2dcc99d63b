"""The operators a pipeline node may name. Each takes (params, inputs) and gives one DataFrame, lazily.

passthrough, filter_rows and union act on real rows here; the rest go beyond them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Op = Callable[[dict, list[DataFrame]], DataFrame]
OPS: dict[str, Op] = {}


class OpError(ValueError):
    pass


def op(name: str) -> Callable[[Op], Op]:
    def add(f: Op) -> Op:
        OPS[name] = f
        return f

    return add


def find(op_type: str) -> Op:
    if op_type not in OPS:
        raise OpError(f"unsupported_op:{op_type}")
    return OPS[op_type]


def one(inputs: list[DataFrame]) -> DataFrame:
    if len(inputs) != 1:
        raise OpError(f"expected one input, got {len(inputs)}")
    return inputs[0]


@op("passthrough")
def passthrough(_: dict, inputs: list[DataFrame]) -> DataFrame:
    return one(inputs)


@op("filter_rows")
def filter_rows(params: dict, inputs: list[DataFrame]) -> DataFrame:
    return one(inputs).filter(params["predicate"]) if params.get("predicate") else one(inputs)


@op("union")
def union(_: dict, inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, by column name; missing columns are null."""
    if not inputs:
        raise OpError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


@op("map")
def project(params: dict, inputs: list[DataFrame]) -> DataFrame:
    return one(inputs).selectExpr(*params["select"])


OPS["transform"] = project


@op("join")
def join(params: dict, inputs: list[DataFrame]) -> DataFrame:
    return inputs[0].join(inputs[1], params["on"], params.get("how", "inner"))


@op("split")
def split(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """Rows with `part`, drawn by a hash of `keys` and seed, so that a row's part never changes."""
    parts, low = params["parts"], 0.0
    draw = F.pmod(F.xxhash64(F.lit(params.get("seed", 0)), *params["keys"]), F.lit(1_000_000)) / 1_000_000
    column, total = None, sum(parts.values())
    for name, share in parts.items():
        low += share / total
        column = F.when(draw < low, name) if column is None else column.when(draw < low, name)
    return one(inputs).withColumn("part", column.otherwise(name))


@op("sample")
def sample(params: dict, inputs: list[DataFrame]) -> DataFrame:
    draw = F.pmod(F.xxhash64(F.lit(params.get("seed", 0)), *params["keys"]), F.lit(1_000_000))
    return one(inputs).filter(draw < int(params["share"] * 1_000_000))


@op("stats")
def stats(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """(column, rows, nulls, low, high, mean) of the numeric columns named, or of all."""
    df = one(inputs)
    names = params.get("columns") or [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("v")) for n in names]))
    return df.select(each.alias("x")).groupBy("x.column").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x.v").isNull()).alias("nulls"), F.min("x.v").alias("low"), F.max("x.v").alias("high"), F.avg("x.v").alias("mean"))


@op("validate")
def validate(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """The input; running it fails at the first row that breaks a check."""
    df = one(inputs)
    for check in params["checks"]:
        df = df.filter(F.when(F.coalesce(F.expr(check), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"check failed: {check}")).cast("boolean")))
    return df


@op("redact")
def redact(params: dict, inputs: list[DataFrame]) -> DataFrame:
    return one(inputs).withColumns({c: F.mask(F.col(c).cast("string")) for c in params["columns"]})


@op("aggregate")
def aggregate(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """Group by `by`, each aggregate an SQL expression under its name; `rollup` and `cube` widen the grouping."""
    df, how = one(inputs), params.get("grouping", "group")
    grouped = {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[how](*params.get("by", []))
    return grouped.agg(*[F.expr(e).alias(n) for n, e in params["aggregates"].items()])


@op("sort")
def sort(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """By expressions, each with DESC behind it or not; with `offset` and `limit` only some of the first rows."""
    order = [F.expr(e[:-5]).desc() if e.upper().endswith(" DESC") else F.expr(e) for e in params["by"]]
    df = one(inputs).orderBy(*order)
    df = df.offset(params["offset"]) if "offset" in params else df
    return df.limit(params["limit"]) if "limit" in params else df


@op("ingest")
def ingest(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """A source: any format Spark reads (parquet, csv, json, orc, jdbc, ...) from `path`, with `options` and a `schema`."""
    if inputs:
        raise OpError("ingest takes no input")
    reader = SparkSession.active().read.format(params.get("format", "parquet")).options(**params.get("options", {}))
    reader = reader.schema(params["schema"]) if params.get("schema") else reader
    return reader.load(params["path"]) if params.get("path") else reader.load()


@op("persist")
def persist(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """Write the input to `path` and go on from what was written; `by` names columns to partition by."""
    df, kind, options = one(inputs), params.get("format", "parquet"), params.get("options", {})
    df.write.format(kind).options(**options).mode(params.get("mode", "error")).partitionBy(*params.get("by", [])).save(params["path"])
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(params["path"])


@op("publish")
def publish(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """Make the input known under a name to SQL of the session, and pass it on."""
    df = one(inputs)
    df.createOrReplaceTempView(params["name"])
    return df


OPS["export"] = persist


@op("interval_join")
def interval_join(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """Left rows with the right rows of the same keys from `before_seconds` before to `after_seconds` after them.

    Time is cut into bins as wide as the interval and a right row goes to its bin alone, a left row to those its
    interval meets, so rows are compared within keys and bins, not within keys.
    """
    left, right = inputs
    keys, at, low, high = params["keys"], params["at"], params["before_seconds"], params["after_seconds"]
    width, micros = max(1, low + high) * 1_000_000, lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    binned = lambda c: F.floor(c / F.lit(width))
    l = left.withColumn("__at", micros(at)).withColumn("__bin", F.explode(F.sequence(binned(F.col("__at") - low * 1_000_000), binned(F.col("__at") + high * 1_000_000))))  # noqa: E741
    r = right.withColumn("__when", micros(params.get("right_at", at)))
    taken = [c for c in right.columns if c not in (*keys, *left.columns)]
    r = r.select(*keys, *taken, "__when", binned(F.col("__when")).alias("__bin"))
    near = l.join(r, [*keys, "__bin"]).filter(F.col("__when").between(F.col("__at") - low * 1_000_000, F.col("__at") + high * 1_000_000))
    return near.select(*left.columns, *taken)


@op("distinct")
def distinct(_: dict, inputs: list[DataFrame]) -> DataFrame:
    return one(inputs).distinct()


@op("intersect")
def intersect(params: dict, inputs: list[DataFrame]) -> DataFrame:
    return inputs[0].intersectAll(inputs[1]) if params.get("all") else inputs[0].intersect(inputs[1])


@op("except")
def except_(params: dict, inputs: list[DataFrame]) -> DataFrame:
    return inputs[0].exceptAll(inputs[1]) if params.get("all") else inputs[0].subtract(inputs[1])


@op("as_of_join")
def as_of_join(params: dict, inputs: list[DataFrame]) -> DataFrame:
    """Each left row with the last right row of the same keys at or before it: one sort of both, no pairs."""
    from pyspark.sql import Window

    left, right = inputs
    keys, at, take = params["keys"], params["at"], params["take"]
    l = left.withColumns({"__side": F.lit(1), "__row": F.struct(*left.columns), "__took": F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType)}).select(*keys, F.col(at).alias("__at"), "__side", "__row", "__took")  # noqa: E741
    r = right.select(*keys, F.col(params.get("right_at", at)).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.struct(*take).alias("__took"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__last", F.last("__took", ignorenulls=True).over(w))
    return both.filter("__side = 1").select("__row.*", *[F.col("__last")[c].alias(f"asof_{c}") for c in take])
