"""Queries of the general data problems (p1, p2, p3, p5, p7) and the same in SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.common import asset_form, plain, table, to_nanos
from fedlens.operators import hierarchy as tree
from fedlens.operators import drift, intervals, orphans, receipts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got = receipts.receive_in_turn(table(spark, d, "messages"))
    return got.surplus.select(F.col("kept").alias("kept_arrival"), F.col("surplus").alias("arrival"))


def p1_missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    return receipts.missing_numbers(receipts.receive_in_turn(table(spark, d, "messages")).seen.ranges)


def _span_times(spark: SparkSession, d: str):
    return table(spark, d, "spans").select("trace_id", "start_unix_nanos", "end_unix_nanos"), plain(F.col("trace_id")), to_nanos(F.col("start_unix_nanos")), to_nanos(F.col("end_unix_nanos"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(*_span_times(spark, d)).withColumnRenamed("entity", "trace_id")


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(*_span_times(spark, d)).withColumnRenamed("entity", "trace_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_records")).select("file_name", "change_kind", "field_name", "new_name")


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields and types of every file."""
    return drift.fields(drift.summarised(drift.lines(table(spark, d, "raw_records")))).select("file_name", F.col("field").alias("field_name"), F.col("type").alias("field_type"))


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_records"), "span")


def p3_materializations(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_records"), "materialization")


def p3_manifests(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "raw_records"), "manifest")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per kind, the rows of its table and how many of its cells hold a value: as many as valid lines and their values other than null."""
    parts = []
    for kind in ("span", "materialization", "manifest"):
        rows = drift.unified(table(spark, d, "raw_records"), kind)
        cells = [F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in rows.columns[2:]]
        parts.append(rows.select(reduce(lambda a, b: a + b, cells, F.lit(0)).alias("held")).agg(F.count(F.lit(1)).alias("rows"), F.sum("held").alias("values")).select(F.lit(kind).alias("record_kind"), "rows", "values"))
    return reduce(DataFrame.unionByName, parts).filter("rows > 0")


UNIT = "\x1f"  # the separator of units, which ids don't hold


def _span_links(spark: SparkSession, d: str):
    parent = plain(F.col("parent_span_id"))
    return table(spark, d, "spans").select("trace_id", "span_id", "parent_span_id"), plain(F.col("trace_id")), plain(F.col("span_id")), F.when(~parent.rlike("^0+$"), parent)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = tree.hierarchy(*_span_links(spark, d), paths=False)
    return found.filter("cycle is not null").select(F.col("entity").alias("trace_id"), F.col("node").alias("span_id"), F.col("cycle").alias("cycle_span_id"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    found = tree.hierarchy(*_span_links(spark, d))
    return found.select(F.col("entity").alias("trace_id"), F.col("node").alias("span_id"), F.col("root").alias("root_span_id"), "depth", "path", F.col("cycle").alias("cycle_span_id"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    below = tree.descendants(tree.hierarchy(*_span_links(spark, d), between=UNIT), between=UNIT)
    return below.select(F.col("entity").alias("trace_id"), F.col("ancestor").alias("ancestor_span_id"), F.col("node").alias("span_id"), F.col("distance").cast("long").alias("distance"))


def p5_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """p5_descendants and the same for spans on or below a loop, which is named and cut above the span that names it."""
    below = tree.descendants(tree.loops_cut(tree.hierarchy(*_span_links(spark, d), between=UNIT), between=UNIT), "cycle", between=UNIT)
    return below.select(F.col("entity").alias("trace_id"), F.col("ancestor").alias("ancestor_span_id"), F.col("node").alias("span_id"), F.col("distance").cast("long").alias("distance"), F.col("cycle").alias("cycle_span_id"))


def span_references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References (ref_table, ref_field, ref_id, kind, key, at) and targets (kind, key, since, until) of problem 7."""
    edges, lineage, nodes, registry = (table(spark, d, n) for n in ("edges", "lineage", "nodes", "registry"))
    ref = lambda df, t, f, no, kind, key: df.select(F.lit(t).alias("ref_table"), F.lit(f).alias("ref_field"), F.col(no).alias("ref_id"), F.lit(kind).alias("kind"), key.alias("key"), F.col("recorded_at").alias("at"))
    inputs = nodes.select("node_no", "recorded_at", F.explode("inputs").alias("asset"))
    refs = [
        ref(edges, "edges", "from_node_id", "edge_no", "node", plain(F.col("from_node_id"))),
        ref(edges, "edges", "to_node_id", "edge_no", "node", plain(F.col("to_node_id"))),
        ref(lineage, "lineage", "input_fingerprint_v0", "lineage_no", "fingerprint", plain(F.col("input_fingerprint_v0"))),
        ref(inputs, "nodes", "inputs", "node_no", "asset", asset_form(F.col("asset"))),
    ]
    target = lambda df, kind, key, since: df.select(F.lit(kind).alias("kind"), key.alias("key"), F.col(since).alias("since"), F.col("removed_at").alias("until"))
    targets = [target(nodes, "node", plain(F.col("node_id")), "recorded_at"), target(registry, "fingerprint", plain(F.col("fingerprint_v0")), "registered_at"), target(registry, "asset", asset_form(F.col("asset_key")), "registered_at")]
    return refs[0].unionByName(refs[1]).unionByName(refs[2]).unionByName(refs[3]).filter("key is not null"), targets[0].unionByName(targets[1]).unionByName(targets[2])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*span_references(spark, d)).select("ref_table", "ref_field", "ref_id", F.col("key").alias("ref_key")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = span_references(spark, d)
    return orphans.orphan_report(refs, targets, ["ref_table", "ref_field"])


QUERIES = {f.__name__: f for f in (p1_found, p1_missing_numbers, p2_found, p2_periods, p3_found, p3_fields, p3_kept, p3_spans, p3_materializations, p3_manifests, p5_found, p5_paths, p5_descendants, p5_all_descendants, p7_found, p7_report)}

_IDENT = """ids AS (SELECT regexp_replace(lower(trim(sender)), '^0x', '') AS k, sequence AS s, CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END AS t, arrival FROM messages
 WHERE sender IS NOT NULL AND trim(sender) <> '' AND ts IS NOT NULL AND sequence IS NOT NULL)"""
_EDGES = """spans_in AS (SELECT lower(trim(trace_id)) AS e,
  CASE WHEN start_unix_nanos >= 100000000000000000 THEN start_unix_nanos WHEN start_unix_nanos >= 100000000000000 THEN start_unix_nanos * 1000 WHEN start_unix_nanos >= 100000000000 THEN start_unix_nanos * 1000000 ELSE start_unix_nanos * 1000000000 END AS s,
  CASE WHEN end_unix_nanos >= 100000000000000000 THEN end_unix_nanos WHEN end_unix_nanos >= 100000000000000 THEN end_unix_nanos * 1000 WHEN end_unix_nanos >= 100000000000 THEN end_unix_nanos * 1000000 ELSE end_unix_nanos * 1000000000 END AS f FROM spans),
 reach AS (SELECT e, s, f, max(f) OVER (PARTITION BY e ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT e, s, f FROM spans_in) WHERE f > s)"""
_LINKS = """n AS (SELECT lower(trim(trace_id)) AS e, lower(trim(span_id)) AS v, min(CASE WHEN regexp_matches(trim(parent_span_id), '^0*$') THEN NULL ELSE lower(trim(parent_span_id)) END) AS p FROM spans GROUP BY 1, 2),
 l AS (SELECT n.e, n.v, m.v AS p FROM n LEFT JOIN n AS m ON m.e = n.e AND m.v = n.p)"""
_REFS = """refs AS (SELECT 'edges' AS ref_table, 'from_node_id' AS ref_field, edge_no AS ref_id, 'node' AS kind, lower(trim(from_node_id)) AS k, recorded_at AS made FROM edges
 UNION SELECT 'edges', 'to_node_id', edge_no, 'node', lower(trim(to_node_id)), recorded_at FROM edges
 UNION SELECT 'lineage', 'input_fingerprint_v0', lineage_no, 'fingerprint', lower(trim(input_fingerprint_v0)), recorded_at FROM lineage
 UNION SELECT 'nodes', 'inputs', node_no, 'asset', trim(rtrim(lower(trim(a)), '/')), recorded_at FROM (SELECT node_no, recorded_at, unnest(inputs) AS a FROM nodes)),
 tg AS (SELECT 'node' AS kind, lower(trim(node_id)) AS k, recorded_at AS since, removed_at AS until FROM nodes
 UNION ALL SELECT 'fingerprint', lower(trim(fingerprint_v0)), registered_at, removed_at FROM registry
 UNION ALL SELECT 'asset', trim(rtrim(lower(trim(asset_key)), '/')), registered_at, removed_at FROM registry),
 gone AS (SELECT * FROM refs WHERE k IS NOT NULL AND k <> '' AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.kind = refs.kind AND tg.k = refs.k AND tg.since <= refs.made AND (tg.until IS NULL OR refs.made < tg.until)))"""

ORACLE = {
    "p1_found": f"WITH {_IDENT} SELECT kept_arrival, arrival FROM (SELECT min(arrival) OVER (PARTITION BY k, s, t) AS kept_arrival, arrival FROM ids) WHERE arrival > kept_arrival",
    "p1_missing_numbers": f"WITH {_IDENT}, u AS (SELECT DISTINCT k, s FROM ids), g AS (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY s) AS nx FROM u) SELECT k AS sender, s + 1 AS missing_from, nx - 1 AS missing_to FROM g WHERE nx > s + 1",
    "p2_found": f"WITH {_EDGES} SELECT e AS trace_id, r AS gap_start, s AS gap_end FROM reach WHERE s > r",
    "p2_periods": f"WITH {_EDGES}, runs AS (SELECT e, s, f, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS run FROM reach) SELECT e AS trace_id, min(s) AS period_start, max(f) AS period_end FROM runs GROUP BY e, run",
    "p3_kept": """WITH ok AS (SELECT record_kind, row_number() OVER () AS r, CAST(body AS JSON) AS j FROM raw_records WHERE body <> '' AND json_valid(body) AND json_type(body) = 'OBJECT'),
 k AS (SELECT record_kind, j, unnest(json_keys(j)) AS f FROM ok), n AS (SELECT record_kind, count(*) AS rows FROM ok GROUP BY 1)
 SELECT record_kind, rows, count(*) FILTER (json_type(j, '$."' || f || '"') <> 'NULL') AS values FROM k JOIN n USING (record_kind) GROUP BY ALL""",
    "p3_fields": """WITH ok AS (SELECT file_name, CAST(body AS JSON) AS j FROM raw_records WHERE body <> '' AND json_valid(body) AND json_type(body) = 'OBJECT'),
 k AS (SELECT file_name, j, unnest(json_keys(j)) AS f FROM ok), t AS (SELECT DISTINCT file_name, f, json_type(j, '$."' || f || '"') AS ty FROM k),
 m AS (SELECT file_name, f, CASE ty WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS ty FROM t WHERE ty <> 'NULL'),
 s AS (SELECT file_name, f, list_sort(list(DISTINCT ty)) AS l FROM m GROUP BY 1, 2)
 SELECT file_name, f AS field_name, CASE WHEN len(l) = 1 THEN l[1] WHEN l = ['integer', 'number'] THEN 'number' ELSE 'string' END AS field_type FROM s""",
    "p5_found": f"WITH RECURSIVE {_LINKS}, up(e, v, a) AS (SELECT e, v, p FROM l WHERE p IS NOT NULL UNION SELECT up.e, up.v, l.p FROM up JOIN l ON l.e = up.e AND l.v = up.a WHERE l.p IS NOT NULL), looped AS (SELECT e, v FROM up WHERE v = a) SELECT up.e AS trace_id, up.v AS span_id, min(up.a) AS cycle_span_id FROM up JOIN looped ON looped.e = up.e AND looped.v = up.a GROUP BY 1, 2",
    "p5_paths": f"""WITH RECURSIVE {_LINKS}, down(e, v, root, depth, path) AS (SELECT e, v, v, 0, v FROM l WHERE p IS NULL UNION ALL SELECT l.e, l.v, d.root, d.depth + 1, d.path || '/' || l.v FROM down d JOIN l ON l.e = d.e AND l.p = d.v),
 up(e, v, a) AS (SELECT l.e, l.v, l.p FROM l LEFT JOIN down ON down.e = l.e AND down.v = l.v WHERE down.v IS NULL UNION SELECT up.e, up.v, l.p FROM up JOIN l ON l.e = up.e AND l.v = up.a), looped AS (SELECT e, v FROM up WHERE v = a)
 SELECT e AS trace_id, v AS span_id, root AS root_span_id, CAST(depth AS BIGINT) AS depth, path, NULL AS cycle_span_id FROM down UNION ALL SELECT up.e, up.v, NULL, NULL, NULL, min(up.a) FROM up JOIN looped ON looped.e = up.e AND looped.v = up.a GROUP BY 1, 2""",
    "p5_descendants": f"WITH RECURSIVE {_LINKS}, tree(e, v, depth) AS (SELECT e, v, 0 FROM l WHERE p IS NULL UNION ALL SELECT l.e, l.v, d.depth + 1 FROM tree d JOIN l ON l.e = d.e AND l.p = d.v), up(e, v, a, far) AS (SELECT l.e, l.v, l.p, 1 FROM l JOIN tree USING (e, v) WHERE l.p IS NOT NULL UNION ALL SELECT up.e, up.v, l.p, up.far + 1 FROM up JOIN l ON l.e = up.e AND l.v = up.a WHERE l.p IS NOT NULL) SELECT e AS trace_id, a AS ancestor_span_id, v AS span_id, CAST(far AS BIGINT) AS distance FROM up",
    "p5_all_descendants": f"""WITH RECURSIVE {_LINKS}, up(e, v, a) AS (SELECT e, v, p FROM l WHERE p IS NOT NULL UNION SELECT up.e, up.v, l.p FROM up JOIN l ON l.e = up.e AND l.v = up.a WHERE l.p IS NOT NULL), looped AS (SELECT e, v FROM up WHERE v = a),
 named AS (SELECT up.e, up.v, min(up.a) AS c FROM up JOIN looped ON looped.e = up.e AND looped.v = up.a GROUP BY 1, 2),
 cut AS (SELECT l.e, l.v, c, CASE WHEN c = l.v THEN NULL ELSE l.p END AS p FROM l LEFT JOIN named ON named.e = l.e AND named.v = l.v),
 way(e, v, c, a, far) AS (SELECT e, v, c, p, 1 FROM cut WHERE p IS NOT NULL UNION ALL SELECT way.e, way.v, way.c, cut.p, way.far + 1 FROM way JOIN cut ON cut.e = way.e AND cut.v = way.a WHERE cut.p IS NOT NULL)
 SELECT e AS trace_id, a AS ancestor_span_id, v AS span_id, CAST(far AS BIGINT) AS distance, c AS cycle_span_id FROM way""",
    "p7_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_field, ref_id, k AS ref_key FROM gone",
    "p7_report": f"WITH {_REFS}, a AS (SELECT ref_table, ref_field, strftime(made, '%Y-%m') AS month, count(*) AS refs FROM refs WHERE k IS NOT NULL AND k <> '' GROUP BY ALL), b AS (SELECT ref_table, ref_field, strftime(made, '%Y-%m') AS month, count(*) AS orphans FROM gone GROUP BY ALL) SELECT a.ref_table, a.ref_field, a.month, a.refs, coalesce(b.orphans, 0) AS orphans FROM a LEFT JOIN b USING (ref_table, ref_field, month)",
}
