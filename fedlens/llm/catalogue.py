"""Queries of the problems tagged llm (p4, p6, p8, p9, p10) and the same in SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedlens.common import NANOS_PER_DAY, staged, table
from fedlens.llm import distinct, languages, mixing, neighbours, packing, percentiles, tokens


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.similar(table(spark, d, "updates"), "update_id", "gradients", least=0.95)
    return near.select(F.least("query", "other").alias("update_id"), F.greatest("query", "other").alias("other_update_id")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every update whose id is divisible by 100, against all rows."""
    near = neighbours.similar(table(spark, d, "updates"), "update_id", "gradients", queries="rep % 100 = 0")
    return near.select(F.col("query").alias("update_id"), F.col("other").alias("other_update_id"), F.round("cosine", 5).alias("cosine"))


def p4_five(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every update, through the index."""
    near = neighbours.similar(table(spark, d, "updates"), "update_id", "gradients")
    return near.select(F.col("query").alias("update_id"), F.col("other").alias("other_update_id"), F.round("cosine", 5).alias("cosine"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the true five most similar that are found, for the query set of p4_neighbours.

    `recall` is that of the index as p4_five asks it, `close_recall` that of the index as p4_found asks it, of those
    of cosine 0.95 or more, and `scanned_recall` what p4_neighbours finds, which reads every row.
    """
    u = table(spark, d, "updates")
    near = lambda **how: neighbours.similar(u, "update_id", "gradients", queries="rep % 100 = 0", **how)
    runs = {"hit": near(through_index=True), "near_hit": near(through_index=True, least=0.95), "scanned": near()}
    both = near(exact=True)
    for name, df in runs.items():
        both = both.join(df.select("query", "other", F.lit(1).alias(name)), ["query", "other"], "left")
    close = F.when(F.col("cosine") >= 0.95, F.lit(1))
    counted = both.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found_pairs"), F.count(close).alias("close_pairs"), F.count(close * F.col("near_hit")).alias("close_found"), F.count("scanned").alias("scanned_found"))
    share = lambda found, of: F.round(F.try_divide(found, of), 4)
    return counted.withColumns({"recall": share("found_pairs", "true_pairs"), "close_recall": share("close_found", "close_pairs"), "scanned_recall": share("scanned_found", "true_pairs")})


def p4_holds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds at least nine of ten true neighbours, and of those of cosine 0.95 or more."""
    r = p4_recall(spark, d)
    return r.select(*[(F.coalesce(c, F.lit(1.0)) >= 0.9).alias(f"{c}_holds") for c in ("recall", "close_recall", "scanned_recall")])


FINITE = "value is not null and not isnan(value) and abs(value) < double('infinity')"


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    """Finite values with name, unit and day; rows repeated but for ingested_at are one measurement."""
    rows = distinct.distinct_rows(table(spark, d, "metrics").filter(FINITE).select("ts_unix_nanos", "trace_id", "span_id", "name", "unit", "value"))
    return rows.select("name", "unit", F.floor(F.col("ts_unix_nanos") / F.lit(NANOS_PER_DAY)).cast("int").alias("day"), "value")


def _metric_sketches(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.sketches(_measurements(spark, d), F.col("value"), {k: F.col(k) for k in ("name", "unit", "day")})


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per name, unit and day, and over all days (day null), which are the days' sketches joined."""
    built = staged(_metric_sketches(spark, d), "percentiles")
    daily = percentiles.percentiles(built, ["name", "unit", "day"], SHARES)
    whole = percentiles.percentiles(built, ["name", "unit"], SHARES).withColumn("day", F.lit(None).cast("int"))
    both = daily.withColumn("period", F.lit("day")).unionByName(whole.withColumn("period", F.lit("all")))
    return both.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).cast("string"))


def p6_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """For each name, unit and day, whether the true ranks of the three percentiles lie within the reported bound."""
    built = percentiles.percentiles(_metric_sketches(spark, d), ["name", "unit", "day"], SHARES)
    m = _measurements(spark, d).toDF("m_name", "m_unit", "m_day", "value")
    joined = m.join(built, m.m_name.eqNullSafe(built.name) & m.m_unit.eqNullSafe(built.unit) & m.m_day.eqNullSafe(built.day))
    below = joined.groupBy("name", "unit", "day", "n", "max_rank_error", *SHARES).agg(*[F.sum((F.col("value") < F.col(p)).cast("long")).alias(f"lt_{p}") for p in SHARES], *[F.sum((F.col("value") <= F.col(p)).cast("long")).alias(f"le_{p}") for p in SHARES], F.count(F.lit(1)).alias("rows"))
    holds = [(F.col(f"lt_{p}") < F.ceil(q * F.col("n")) + F.col("max_rank_error")) & (F.col(f"le_{p}") >= F.ceil(q * F.col("n")) - F.col("max_rank_error")) for p, q in SHARES.items()]
    return below.select("name", "unit", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).cast("string").alias("day"), "n", (holds[0] & holds[1] & holds[2] & (F.col("rows") == F.col("n"))).alias("holds"))


def _packed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, packing.Plan]]:
    sizes = staged(tokens.token_counts(table(spark, d, "documents")), "tokens")
    kinds = table(spark, d, "containers").filter("capacity_tokens > 0").select("container_kind", "capacity_tokens").collect()  # a row per kind
    return [(r["container_kind"], *packing.pack(sizes, r["capacity_tokens"])) for r in sorted(kinds)]


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of one longer than the container, in its container of each kind."""
    parts = [p.select(F.lit(kind).alias("container_kind"), F.col("container").alias("container_no"), F.col("id").alias("doc_id"), F.col("part").alias("part_no"), F.col("length").alias("tokens")) for kind, p, _ in _packed(spark, d)]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "container_kind string, container_no long, doc_id long, part_no long, tokens int"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: containers, the fewest possible by size, their fill, and the fullest."""
    parts = []
    for kind, p, made in _packed(spark, d):
        each = p.groupBy("container").agg(F.sum("length").alias("used"))
        parts.append(each.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most")).select(F.lit(kind).alias("container_kind"), F.lit(made.capacity).alias("capacity_tokens"), "containers", F.ceil(F.col("tokens") / made.capacity).alias("fewest"), "tokens", "most", F.round(F.try_divide(F.col("tokens"), F.col("containers") * made.capacity), 6).alias("fill")))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "container_kind string, capacity_tokens int, containers long, fewest long, tokens long, most int, fill double"))


def p8_holds(spark: SparkSession, d: str) -> DataFrame:
    """Per kind, whether every token is in a container once, none is over its capacity, only longer texts are cut, and at most 1 % more containers are used than the fewest possible."""
    sizes = staged(tokens.token_counts(table(spark, d, "documents")), "tokens")
    kinds = table(spark, d, "containers").filter("capacity_tokens > 0").select("container_kind", "capacity_tokens").collect()  # a row per kind
    parts = []
    for kind, capacity in sorted(kinds):
        rows = staged(packing.pack(sizes, capacity)[0], "packed")
        each = rows.groupBy("id").agg(F.sum("length").alias("got"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("part").alias("different"))
        both = sizes.filter("id is not null and tokens > 0").join(each, "id", "full")
        whole = both.agg(F.coalesce(F.bool_and(F.coalesce((F.col("got") == F.col("tokens")) & (F.col("pieces") == F.col("different")), F.lit(False))), F.lit(True)).alias("each_token_once"), F.coalesce(F.bool_and((F.col("pieces") == 1) | (F.col("tokens") > capacity)), F.lit(True)).alias("cut_only_if_longer"))
        used = rows.groupBy("container").agg(F.sum("length").alias("used")).agg(F.coalesce(F.max("used") <= capacity, F.lit(True)).alias("within_capacity"), F.coalesce(F.count(F.lit(1)) <= F.ceil(F.ceil(F.sum("used") / capacity) * 1.01), F.lit(True)).alias("near_fewest"))
        parts.append(whole.join(F.broadcast(used)).select(F.lit(kind).alias("container_kind"), "each_token_once", "cut_only_if_longer", "within_capacity", "near_fewest"))  # one row each
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "container_kind string, each_token_once boolean, cut_only_if_longer boolean, within_capacity boolean, near_fewest boolean"))


def _mixed(spark: SparkSession, d: str, whole: bool = False):
    docs = table(spark, d, "documents")
    sizes = staged(tokens.token_counts(docs, extra={"source": docs["source"]}), "tokens")
    listed = table(spark, d, "mix_targets").withColumn("source", mixing.source_form(F.col("source")))
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in listed.collect()}  # a row per source
    total = float(sizes.agg(F.sum("tokens")).first()[0] or 0) if whole else None
    return targets, mixing.mix(sizes, targets, total), sizes


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix in which every source has its share."""
    _, (mixed, _, _), _ = _mixed(spark, d)
    return mixed.select(F.col("id").alias("doc_id"), "source", "copy", "tokens")


def p9_mix_whole(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as all texts together: sources repeat up to their caps and fall short of their shares where these bind."""
    _, (mixed, _, _), _ = _mixed(spark, d, whole=True)
    return mixed.select(F.col("id").alias("doc_id"), "source", "copy", "tokens")


def p9_holds(spark: SparkSession, d: str) -> DataFrame:
    """Per source and mix, whether no text occurs more often than its source's cap, and the tokens come within 2 % of the mix, or two of the source's longest texts, of what the rate asks for."""
    parts = []
    for name, whole in (("exact shares", False), ("size of the input", True)):
        targets, (mixed, rate, held), sizes = _mixed(spark, d, whole)
        mixed = staged(mixed, "mixed")
        reached = mixing.shares(mixed, targets, rate, held)
        longest = sizes.groupBy(mixing.source_form(F.col("source")).alias("source")).agg(F.max("tokens").alias("longest"))
        every = mixed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("every"))
        off = F.abs(F.col("mix_tokens") - F.col("rate") * F.col("source_tokens"))
        checked = reached.join(longest, "source", "left").join(F.broadcast(every))  # one row
        parts.append(checked.select(F.lit(name).alias("mix"), "source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (off <= F.greatest(0.02 * F.col("every"), 2 * F.coalesce("longest", F.lit(0)))).alias("as_asked")))
    return reduce(DataFrame.unionByName, parts)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted and reached: in that mix, and in one as large as all texts together, where caps may bind."""
    parts = []
    for name, whole in (("exact shares", False), ("size of the input", True)):
        targets, (mixed, rate, held), _ = _mixed(spark, d, whole)
        parts.append(mixing.shares(mixed, targets, rate, held).withColumn("mix", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents"), table(spark, d, "languages"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(_parts(spark, d)).select(F.col("id").alias("doc_id"), "seg_no", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(F.col("id").alias("doc_id"), "seg_no", "parts", "lang", F.round("confidence", 6).alias("confidence"), "sentences", "first_sentence", "characters")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """The main language of each text, that of most characters, with what its label said."""
    best = _parts(spark, d).groupBy("id", "label").agg(F.max_by("lang", "characters").alias("lang"), F.max_by("confidence", "characters").alias("confidence"), F.count(F.lit(1)).alias("parts"))
    return best.select(F.col("id").alias("doc_id"), F.col("label").alias("label_lang"), "lang", F.round("confidence", 6).alias("confidence"), "parts")


def p10_holds(spark: SparkSession, d: str) -> DataFrame:
    """Whether parts are numbered in order, neighbouring parts differ, at least four of five texts of one language agree with their label, and those that don't are less certain on average."""
    rows = staged(_parts(spark, d), "languages-parts")
    w = Window.partitionBy("id").orderBy("seg_no")
    turns = rows.select("seg_no", F.row_number().over(w).alias("n"), (F.col("lang") == F.lag("lang").over(w)).alias("same"))
    order = turns.agg(F.coalesce(F.bool_and(F.col("seg_no") == F.col("n")), F.lit(True)).alias("numbered"), F.coalesce(~F.bool_or("same"), F.lit(True)).alias("neighbours_differ"))
    lone = rows.filter("parts = 1 and label is not null").groupBy((F.col("label") == F.col("lang")).alias("agrees")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("sure"))
    pick = lambda c, of: F.max(F.when(F.col("agrees") == F.lit(of), F.col(c)))
    fit = lone.agg(F.coalesce(pick("n", True) >= 4 * F.coalesce(pick("n", False), F.lit(0)), F.lit(True)).alias("labels_agree"), F.coalesce(pick("sure", True) > pick("sure", False), F.lit(True)).alias("wrong_less_certain"))
    return order.join(F.broadcast(fit))  # one row each


QUERIES = {f.__name__: f for f in (p4_found, p4_neighbours, p4_five, p4_recall, p4_holds, p6_percentiles, p6_bounds_hold, p8_packing, p8_fill, p8_holds, p9_mix, p9_mix_whole, p9_shares, p9_holds, p10_found, p10_segments, p10_documents, p10_holds)}

ORACLE = {
    "p4_holds": "SELECT true AS recall_holds, true AS close_recall_holds, true AS scanned_recall_holds",
    "p8_holds": "SELECT container_kind, true AS each_token_once, true AS cut_only_if_longer, true AS within_capacity, true AS near_fewest FROM containers WHERE capacity_tokens > 0",
    "p9_holds": "SELECT mix, replace(replace(lower(trim(source)), '_', '-'), ' ', '-') AS source, true AS within_cap, true AS as_asked FROM mix_targets, (VALUES ('exact shares'), ('size of the input')) AS m(mix)",
    "p10_holds": "SELECT true AS numbered, true AS neighbours_differ, true AS labels_agree, true AS wrong_less_certain",
    "p6_bounds_hold": "SELECT name, unit, CAST(DATE '1970-01-01' + CAST(ts_unix_nanos // 86400000000000 AS INTEGER) AS VARCHAR) AS day, count(*) AS n, true AS holds FROM (SELECT DISTINCT ts_unix_nanos, trace_id, span_id, name, unit, value FROM metrics WHERE isfinite(value)) GROUP BY 1, 2, 3",
    "p4_found": """WITH v AS (SELECT update_id AS i, any_value(CAST(gradients AS DOUBLE[])) AS g FROM updates WHERE len(gradients) = 64 AND len(list_filter(gradients, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(gradients, lambda x: x <> 0)) > 0 GROUP BY 1),
 w AS (SELECT i, list_transform(g, lambda x: x / sqrt(list_inner_product(g, g))) AS g FROM v),
 c AS (SELECT a.i AS q, b.i AS o, list_inner_product(a.g, b.g) AS s FROM w AS a JOIN w AS b ON a.i <> b.i),
 r AS (SELECT q, o, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) AS n FROM c)
 SELECT DISTINCT least(q, o) AS update_id, greatest(q, o) AS other_update_id FROM r WHERE n <= 5 AND s >= 0.95""",
}
