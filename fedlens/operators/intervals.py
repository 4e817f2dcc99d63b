"""Overlapping, nested and gapped intervals per entity: continuous periods and the gaps between them.

Sweep line: every interval gives +1 at its start and -1 at its end; the prefix sum of those over an
entity's instants is the number of intervals open. A period runs from an instant where it leaves zero to
the next where it returns, a gap from there to the entity's next instant.

Scale: boundaries are summed per (entity, instant) before the shuffle, so repeated rows collapse in the map
tasks and instants whose changes cancel are dropped. An entity with more than `HOT` boundaries is cut into
stretches between approximate quantiles of its own instants, so that far-off instants don't matter; sums per
stretch give each stretch the count it starts with and the instant that follows it, so no entity is ever one
task's work.

Defined results: an interval without entity, start or end, or whose end is not after its start, does not
count; intervals that touch leave no gap; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedlens.common import staged

HOT, MOST_PIECES = 200_000, 1000


def boundaries(df: DataFrame, entity: Column, start: Column, end: Column) -> DataFrame:
    """(entity, at, step): the net change of the open count at each instant where it isn't zero."""
    rows = df.select(entity.alias("entity"), start.alias("s"), end.alias("e")).filter("entity is not null and e > s")
    events = rows.select("entity", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("step")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("step")))).alias("b")).select("entity", "b.at", "b.step")
    return events.groupBy("entity", "at").agg(F.sum("step").alias("step")).filter("step <> 0")


def swept(df: DataFrame, entity: Column, start: Column, end: Column, hot: int = HOT) -> tuple[DataFrame, bool]:
    """(entity, piece, at, step, active, next_at): the open count from each boundary on and the boundary after it; whether any entity is in pieces."""
    rows = df.select(entity.alias("entity"), start.alias("s"), end.alias("e")).filter("entity is not null and e > s")
    busy = rows.groupBy("entity").agg((2 * F.count(F.lit(1))).alias("n")).filter(F.col("n") > hot)
    events = boundaries(df, entity, start, end)
    w = Window.partitionBy("entity", "piece").orderBy("at")
    largest = busy.agg(F.max("n")).first()[0]
    if largest is None:
        whole = Window.partitionBy("entity").orderBy("at")
        return events.select("entity", F.lit(0).cast("long").alias("piece"), "at", "step", F.sum("step").over(whole).alias("active"), F.lead("at").over(whole).alias("next_at")), False
    parts = min(MOST_PIECES, -(-2 * largest // hot))
    bounds = rows.join(busy, "entity").groupBy("entity").agg(F.percentile_approx("s", [k / parts for k in range(1, parts)], 10 * parts).alias("bounds"))
    busy = staged(bounds, "intervals-bounds")
    cut = events.join(busy, "entity", "left").select("entity", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("at"))), F.lit(0)).cast("long").alias("piece"), "at", "step")
    sums = cut.join(busy.select("entity"), "entity", "left_semi").groupBy("entity", "piece").agg(F.sum("step").alias("sum"), F.min("at").alias("first"))
    over = Window.partitionBy("entity").orderBy("piece")
    heads = sums.select("entity", "piece", F.sum("sum").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("first").over(over).alias("after"))
    inner = cut.select("entity", "piece", "at", "step", F.sum("step").over(w).alias("inside"), F.lead("at").over(w).alias("inside_next"))
    line = inner.join(heads, ["entity", "piece"], "left")
    return line.select("entity", "piece", "at", "step", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("active"), F.coalesce("inside_next", "after").alias("next_at")), True


def gaps(df: DataFrame, entity: Column, start: Column, end: Column, hot: int = HOT) -> DataFrame:
    """(entity, gap_start, gap_end) between an entity's periods."""
    line, _ = swept(df, entity, start, end, hot)
    return line.filter("active = 0 and next_at is not null").select("entity", F.col("at").alias("gap_start"), F.col("next_at").alias("gap_end"))


def periods(df: DataFrame, entity: Column, start: Column, end: Column, hot: int = HOT) -> DataFrame:
    """(entity, period_start, period_end): the continuous periods.

    A period ends where the count returns to zero and began at the last instant where it left zero; that
    instant is carried from piece to piece as the running maximum of such instants.
    """
    line, pieces = swept(df, entity, start, end, hot)
    line = line.withColumn("opened", F.when(F.col("active") == F.col("step"), F.col("at")))
    w = Window.partitionBy("entity", "piece").orderBy("at")
    line = line.withColumn("since", F.max("opened").over(w))
    if pieces:
        over = Window.partitionBy("entity").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        carried = line.groupBy("entity", "piece").agg(F.max("opened").alias("last")).select("entity", "piece", F.max("last").over(over).alias("carried"))
        line = line.join(carried, ["entity", "piece"], "left").withColumn("since", F.coalesce("since", "carried"))
    return line.filter("active = 0").select("entity", F.col("since").alias("period_start"), F.col("at").alias("period_end"))
