"""References to records that do not exist, were removed, or came later.

A reference (kind, key) made at an instant is an orphan if no target of that kind and key is live then; a
target is live from one instant, included, to another, excluded (null: for ever).

Method, skew-aware split. References are pre-aggregated per (kind, key, period) to a count and the first and
last instant, before any shuffle. From the counts come the heavy keys, those with `SHARE` of all references or
more; there can be no more than 1 / `SHARE` of them. The live intervals of heavy keys are broadcast, as long as
a key has at most `INTERVALS`, and their references are checked where they lie and never move. For all other
keys the aggregates, not the references, meet the live intervals of their key: a shuffled anti-join finds the
(key, period) during which nothing was live, all of whose references are orphans; those during which one
interval was live throughout have none; only the references of the few others are checked one by one. Both
parts are united.

Scale: at most 1 / `SHARE` x `INTERVALS` rows are broadcast. The intervals of a key are merged to disjoint ones
first, so a key removed and recorded again a few times has a few, and a reference meets only those of its month;
a target table full of repeated rows collapses in the map tasks. A key beyond `INTERVALS` goes the shuffled
way, however heavy it is.

Defined results: null and blank references are none; a reference without an instant is an orphan only if its
key is never live; repeated rows of a reference are one for `orphan_report`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedlens.common import staged

SHARE, INTERVALS = 1 / 2000, 200
KEY = ["kind", "key"]


def live_intervals(targets: DataFrame) -> DataFrame:
    """Disjoint (kind, key, since, until) of targets (kind, key, since, until); until null means for ever."""
    rows = targets.filter("kind is not null and key is not null and since is not null and (until is null or until > since)").distinct()
    w = Window.partitionBy("kind", "key").orderBy("since", F.col("until").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    endless = F.max(F.col("until").isNull()).over(before)
    opens = F.when(F.coalesce(endless, F.lit(False)) | (F.col("since") <= F.max("until").over(before)), 0).otherwise(1)
    runs = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    merged = runs.groupBy("kind", "key", "run").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.max(F.col("until").isNull()).alias("endless"))
    return merged.select("kind", "key", "since", F.when(~F.col("endless"), F.col("until")).alias("until"))


def month(at: Column | str) -> Column:
    return F.date_trunc("month", at)


def counted(references: DataFrame, by: list[str]) -> DataFrame:
    """(kind, key, by..., __period, __n, __first, __last): references per key and month of `at`."""
    return references.groupBy(*KEY, *by, month("at").alias("__period")).agg(F.count(F.lit(1)).alias("__n"), F.min("at").alias("__first"), F.max("at").alias("__last"))


def heavy_keys(per_period: DataFrame, live: DataFrame, share: float = SHARE, intervals: int = INTERVALS) -> list[tuple[str, str]]:
    """The keys with `share` of all references or more, and with at most `intervals` live intervals; never more than 1 / share keys."""
    total = per_period.agg(F.sum("__n")).first()[0] or 0
    often = per_period.groupBy(*KEY).agg(F.sum("__n").alias("n")).filter(F.col("n") >= max(2.0, share * total)).select(*KEY)
    found = live.join(F.broadcast(often), KEY, "right").groupBy(*KEY).agg(F.count("since").alias("spells")).filter(F.col("spells") <= intervals)
    return sorted((r["kind"], r["key"]) for r in found.collect())  # at most 1 / share rows


def _dead() -> Column:
    """Whether no interval of the list `__live` holds the instant `at`."""
    return F.expr("__live is null or (at is not null and not exists(__live, x -> x.since <= at and (x.until is null or at < x.until)))")


def _lists(live: DataFrame) -> DataFrame:
    return live.groupBy(*KEY).agg(F.collect_list(F.struct("since", "until")).alias("__live"))


def _parts(references: DataFrame, targets: DataFrame, by: list[str], share: float, intervals: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orphans among references of heavy keys; (kind, key, by..., __period, __n) of which all references are orphans; (kind, key, by..., __period, __live) of which some may be."""
    spark = references.sparkSession
    live = staged(live_intervals(targets), "orphans-live")
    per_period = staged(counted(references, by), "orphans-periods")
    heavy = heavy_keys(per_period, live, share, intervals)
    marks = spark.createDataFrame(heavy, "kind string, key string")
    busy_live = F.broadcast(_lists(live.join(F.broadcast(marks), KEY, "left_semi")))  # 1 / share x intervals at most
    busy = references.join(F.broadcast(marks), KEY, "left_semi").join(busy_live, KEY, "left").filter(_dead()).drop("__live")
    rest = per_period.join(F.broadcast(marks), KEY, "left_anti")
    c = F.col
    touches = c("__first").isNull() | ((c("__since") <= c("__last")) & (c("__until").isNull() | (c("__first") < c("__until"))))
    throughout = c("__first").isNull() | ((c("__since") <= c("__first")) & (c("__until").isNull() | (c("__last") < c("__until"))))
    spells = live.select(*[c(n).alias(f"__{n}") for n in (*KEY, "since", "until")])
    same = (c("kind") == c("__kind")) & (c("key") == c("__key"))
    gone = rest.join(spells, same & touches, "left_anti")
    partly = rest.join(spells, same & touches & ~throughout, "left_semi").join(spells, same & throughout, "left_anti")
    near = partly.select(*KEY, *by, "__period", "__first", "__last").join(spells, same & touches)  # of a key's intervals those of the period
    mixed = near.groupBy(*KEY, *by, "__period").agg(F.collect_list(F.struct(c("__since").alias("since"), c("__until").alias("until"))).alias("__live"))
    return busy, gone, mixed


def _checked(references: DataFrame, periods: DataFrame) -> DataFrame:
    """The orphans among references of `periods` (kind, key, by..., __period, __live), the list null where nothing was live."""
    by = [c for c in periods.columns if c not in ("__period", "__live")]
    match = [F.col(n).eqNullSafe(F.col(f"__m_{n}")) for n in by if n not in KEY] + [F.col(n) == F.col(f"__m_{n}") for n in KEY] + [month("at").eqNullSafe(F.col("__m_period"))]
    named = periods.select(*[F.col(n).alias(f"__m_{n}") for n in by], F.col("__period").alias("__m_period"), "__live")
    return references.join(named, reduce(lambda a, b: a & b, match)).filter(_dead()).select(*references.columns)


def _valid(references: DataFrame) -> DataFrame:
    return references.filter("kind is not null and key is not null")


def orphans(references: DataFrame, targets: DataFrame, share: float = SHARE, intervals: int = INTERVALS) -> DataFrame:
    """The rows of references (kind, key, at, ...) with no live target; all their columns are kept."""
    refs = _valid(references)
    busy, gone, mixed = _parts(refs, targets, [], share, intervals)
    periods = gone.select(*KEY, "__period", F.lit(None).cast(mixed.schema["__live"].dataType).alias("__live")).unionByName(mixed)
    return busy.unionByName(_checked(refs, periods))


def orphan_report(references: DataFrame, targets: DataFrame, by: list[str], share: float = SHARE, intervals: int = INTERVALS) -> DataFrame:
    """(by..., month, refs, orphans): of whole dead periods the counts are summed, their references are not read again."""
    refs = staged(_valid(references).distinct(), "orphans-references")
    busy, gone, mixed = _parts(refs, targets, [c for c in by if c not in KEY], share, intervals)
    text = F.date_format("__period", "yyyy-MM").alias("month")
    lost = [d.groupBy(*by, month("at").alias("__period")).agg(F.count(F.lit(1)).alias("n")).select(*by, text, "n") for d in (busy, _checked(refs, mixed))]
    every = gone.select(*by, text, F.col("__n").alias("n")).unionByName(lost[0]).unionByName(lost[1]).select(*by, "month", F.lit(0).alias("refs"), F.col("n").alias("orphans"))
    seen = refs.groupBy(*by, month("at").alias("__period")).agg(F.count(F.lit(1)).alias("refs")).select(*by, text, "refs", F.lit(0).alias("orphans"))
    return seen.unionByName(every).groupBy(*by, "month").agg(F.sum("refs").alias("refs"), F.sum("orphans").alias("orphans"))
