"""Further registered queries: whole runs and their stores, pipelines over files, codecs, and message work, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.common import asset_form, plain, sender_form, shared_dir, table, whole_seconds
from fedlens.functions import generators, identity, signatures
from fedlens.operators import messages, records, vectors
from fedlens.plans import config, graph, ops, report
from fedlens.plans.catalogue import LONG, ROUND, query
from fedlens.plans.session import Session, permit_all
from fedlens.sources import store


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _bundle(spark: SparkSession) -> store.Bundle:
    return store.Bundle.create(spark, _folder(spark, "runs"), uuid.uuid4().hex)


# vectors
@query("SELECT CAST(a.label AS BIGINT) AS label, a.vec_id, b.vec_id AS other, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 5) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def vec_pairwise_dist(spark: SparkSession, d: str) -> DataFrame:
    """Squared distances of all pairs of a round, which is what is asked for: pairs grow with the square of a round."""
    return vectors.pairwise_distances(table(spark, d, "embeddings"), *ROUND).select(F.col("round").alias("label"), F.col("sender").alias("vec_id"), "other", F.round("distance", 5).alias("distance"))


@query(f"""WITH {LONG}, n AS (SELECT vec_id, len(embedding) AS n, CAST(ceil(CAST(len(embedding) AS FLOAT) * CAST(0.1 AS FLOAT)) AS BIGINT) AS k FROM embeddings)
 SELECT vec_id, how, CAST(bytes AS BIGINT) AS bytes, round(CASE WHEN n = 0 THEN 1.0 ELSE n * 4.0 / bytes END, 4) AS ratio FROM (SELECT vec_id, n, unnest(['dense', 'int8', 'random_sparse', 'top_k', 'top_k_int8']) AS how, unnest([n * 4, n, k * 8, k * 8, k * 5]) AS bytes FROM n)""")
def vec_sizes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    each = [F.struct(F.lit(h).alias("how"), vectors.compressed_size(v, h, 0.1).alias("bytes"), F.round(vectors.compression_ratio(v, h, 0.1), 4).alias("ratio")) for h in ("dense", "int8", "random_sparse", "top_k", "top_k_int8")]
    return table(spark, d, "embeddings").select("vec_id", F.explode(F.array(*each)).alias("x")).select("vec_id", "x.*")


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, true AS same FROM embeddings")
def vec_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as bytes and back."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.dense_bytes("embedding").alias("packed"))
    return e.select("vec_id", F.octet_length("packed").cast("long").alias("bytes"), (vectors.from_dense_bytes("packed") == F.col("embedding")).alias("same"))


_Q = "greatest(CAST(-128 AS FLOAT), least(CAST(127 AS FLOAT), g / CAST(0.01 AS FLOAT)))"


@query(f"WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(g) DESC, i) AS rn, count(*) OVER (PARTITION BY vec_id) AS n FROM long) SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(trunc({_Q}) AS INTEGER) AS q FROM r WHERE rn <= ceil(CAST(n AS FLOAT) * CAST(0.1 AS FLOAT))")
def vec_topk_quantize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.explode(vectors.top_k_quantized(F.col("embedding"), 0.1, 0.01)).alias("p"))
    return e.select("vec_id", "p.i", F.col("p.q").cast("int").alias("q"))


@query("SELECT vec_id, 0 AS outside, true AS rescaled FROM embeddings")
def vec_random_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Whether what a random choice of values keeps lies inside the vector and is rescaled."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.random_sparse(F.col("embedding"), F.col("vec_id"), 0.5).alias("p"))
    outside = F.size(F.filter("p", lambda x: (x["i"] < 0) | (x["i"] >= F.size("embedding"))))
    return e.select("vec_id", outside.alias("outside"), F.forall("p", lambda x: F.abs(x["value"] - F.get("embedding", x["i"]) * 2) <= 1e-6).alias("rescaled"))


@query("SELECT 'fedavg' AS aggregator, CAST(0.0 AS DOUBLE) AS tolerance, 'linear' AS complexity UNION ALL SELECT 'trimmed_mean', 0.2, 'linear' UNION ALL SELECT 'median', 0.5, 'linear' UNION ALL SELECT 'krum', 0.33, 'quadratic'")
def vec_aggregators(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, float(t), c) for n, (_, t, c) in vectors.AGGREGATORS.items() if n != "midrange"], "aggregator string, tolerance double, complexity string")


@query(f"WITH {LONG} SELECT CAST(label AS BIGINT) AS label, CAST(i AS INTEGER) AS i, round(CAST(CAST((max(CAST(g AS DOUBLE)) + min(CAST(g AS DOUBLE))) / 2 AS FLOAT) AS DOUBLE), 6) AS value FROM long GROUP BY ALL")
def vec_custom(spark: SparkSession, d: str) -> DataFrame:
    """An aggregator of one's own, half way between the extremes, in the pipeline."""

    def midrange(df: DataFrame, round_col: str, sender: str, vec: str) -> DataFrame:
        rows = vectors.long_form(df, round_col, sender, vec)
        return rows.groupBy("round", "i").agg(((F.max(F.col("value").cast("double")) + F.min(F.col("value").cast("double"))) / 2).alias("value"))

    if "midrange" not in vectors.AGGREGATORS:
        vectors.register_aggregator("midrange", midrange)
    out = vectors.pipeline(table(spark, d, "embeddings"), *ROUND, how="midrange")
    return out.select(F.col("round").cast("long").alias("label"), F.posexplode("vec").alias("i", "v")).select("label", "i", F.round(F.col("v").cast("double"), 6).alias("value"))


# records
_FROM_OLD = "SELECT CAST(lineage_no + 1 AS BIGINT) AS record_seq, output_fingerprint_v0 AS asset_key, 'unknown' AS op_type, CASE WHEN lineage_no % 3 = 0 THEN 'hit' WHEN lineage_no % 3 = 1 THEN 'miss' ELSE 'unknown' END AS cache_decision, CASE WHEN lineage_no % 3 < 2 THEN lineage_no % 3 = 0 END AS cache_hit, true AS unsafe_surface, 'missing_provenance' AS reasons, 'ok' AS status FROM lineage"
_FROM_NEW = "SELECT entry_no, asset_key, 'ingest', CASE WHEN entry_no % 2 = 0 THEN 'hit' ELSE 'miss' END, entry_no % 2 = 0, false, 'none', 'ok' FROM registry"


@query(f"{_FROM_OLD} UNION ALL {_FROM_NEW}")
def rec_compat(spark: SparkSession, d: str) -> DataFrame:
    """Materialisations of the first version, made from lineage, and of the second, from the registry, as rows of the second."""
    from pyspark.sql import types as T

    names = T._parse_datatype_string(records.MATERIALIZATION)
    as_record = lambda df, **have: df.select(F.col("no").alias("__position"), *[(F.expr(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in names])
    old = as_record(table(spark, d, "lineage").withColumnRenamed("lineage_no", "no"), asset_key="output_fingerprint_v0", cache_hit="case when no % 3 < 2 then no % 3 = 0 end")
    new = as_record(table(spark, d, "registry").withColumnRenamed("entry_no", "no"), asset_key="asset_key", record_seq="no", op_type="'ingest'", cache_decision="case when no % 2 = 0 then 'hit' else 'miss' end")
    v2 = records.to_v2(old.unionByName(new), F.col("__position"))
    return v2.select("record_seq", "asset_key", "op_type", "cache_decision", "cache_hit", "unsafe_surface", identity.joined(F.col("unsafe_reasons")).alias("reasons"), "status")


BOUNDS = [-100.0, 0.0, 1.0, 10.0, 100.0, 1000.0]


@query(f"SELECT name, bucket, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT name, value, len(list_filter({BOUNDS}, lambda b: b < value)) AS bucket FROM metrics WHERE isfinite(value)) GROUP BY ALL")
def rec_histogram(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics").filter("not isnan(value) and abs(value) < double('infinity')")
    h = records.histogram(m, ["name"], "value", BOUNDS)
    return h.select("name", "bucket", "n", F.round("total", 3).alias("total"))


@query("SELECT name, arg_max(value, (ts_unix_nanos, value)) AS value, max(ts_unix_nanos) AS at FROM metrics WHERE isfinite(value) GROUP BY 1")
def rec_gauges(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each metric, of several at one instant the largest."""
    m = table(spark, d, "metrics").filter("not isnan(value) and abs(value) < double('infinity')")
    return records.gauges(m, ["name"], "ts_unix_nanos", "value").select("name", "value", F.col("at").alias("at"))


_KINDS = "CASE json_type({}) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'float' END"


@query(f"WITH ok AS (SELECT CAST(body AS JSON) AS j FROM raw_records WHERE body <> '' AND json_valid(body) AND json_type(body) = 'OBJECT'), k AS (SELECT j, unnest(json_keys(j)) AS field FROM ok) SELECT field, {_KINDS.format(chr(39).join(['j, ', '$.' + chr(34), ' || field || ', chr(34), '']))} AS kind, count(*) AS n FROM k GROUP BY ALL")
def rec_value_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How often each field of the raw records holds each kind of value."""
    raw = table(spark, d, "raw_records").select(F.try_parse_json("body").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    each = spark.sql("SELECT e.key AS field, e.value AS value FROM {raw}, LATERAL variant_explode(v) AS e", raw=raw)
    return each.groupBy("field", records.value_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT node_no, coalesce(nullif(array_to_string(list_transform(inputs, lambda x: x), ','), ''), 'none') AS inputs, replace(replace(replace(replace(replace('<b a="' || coalesce(params, '') || '">&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe,
 CASE WHEN op_kind = 'data' THEN 'custom:' || coalesce(op_type, '') ELSE lower(op_kind) END AS marker, coalesce(code_ref, '?') AS code FROM nodes""")
def rec_text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Lists, markup, markers and missing values of the nodes as a page shows them."""
    n = table(spark, d, "nodes")
    mode = F.when(F.col("op_kind") == "data", "Custom").otherwise(F.col("op_kind"))
    return n.select("node_no", identity.joined(F.col("inputs")).alias("inputs"), identity.escaped_html(F.concat(F.lit('<b a="'), F.coalesce("params", F.lit("")), F.lit("\">&'"))).alias("safe"), identity.auth_marker(mode, F.col("op_type")).alias("marker"), identity.shown(F.col("code_ref")).alias("code"))


@query("SELECT entry_no, 'x/' || (entry_no % 7) || '/y.json' AS path FROM registry")
def rec_relative_paths(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "registry").select("entry_no", F.concat(F.lit("/runs/one\\x\\"), F.col("entry_no") % 7, F.lit("\\y.json")).alias("p"))
    return r.select("entry_no", identity.relative_path(F.col("p"), F.lit("/runs/one")).alias("path"))


# messages
@query("SELECT batch_id, count(*) AS votes, CAST(sum(1 + sequence % 3) AS BIGINT) AS weight, coalesce(sum(1 + sequence % 3) FILTER (sig_valid), 0) / sum(1 + sequence % 3) >= 0.67 AS reached FROM messages WHERE message_type = 3 GROUP BY 1")
def msg_weighted_quorum(spark: SparkSession, d: str) -> DataFrame:
    """Votes weighted by a number of the message."""
    v = messages.quorum(table(spark, d, "messages").filter("message_type = 3"), "batch_id", F.col("sig_valid"), weight=F.lit(1) + F.col("sequence") % 3)
    return v.select(F.col("round").alias("batch_id"), "votes", F.col("weight").cast("long").alias("weight"), "reached")


_PEER = "CASE WHEN lower(trim(sender)) LIKE '0x%' THEN substr(lower(trim(sender)), 3) ELSE lower(trim(sender)) END"


@query(f"""WITH m AS (SELECT *, {_PEER} AS k FROM messages),
 r AS (SELECT *, CASE WHEN version_major IS DISTINCT FROM 0 OR version_minor IS DISTINCT FROM 1 THEN 'unsupported_version' WHEN ts IS NULL OR now IS NULL OR abs(now - ts) > 3600 THEN 'expired' WHEN k IS NULL OR NOT regexp_full_match(k, '[0-9a-f]{{64}}') OR regexp_full_match(k, '0*') THEN 'invalid_sender' END AS reason FROM m),
 w AS (SELECT *, max(sequence) OVER (PARTITION BY k ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER (PARTITION BY k, sequence ORDER BY arrival) AS nth FROM r WHERE reason IS NULL)
 SELECT arrival, reason AS verdict FROM r WHERE reason IS NOT NULL UNION ALL SELECT arrival, CASE WHEN prev IS NULL THEN 'ok' WHEN sequence <= prev - 256 THEN 'too_old' WHEN nth > 1 THEN 'replay' ELSE 'ok' END FROM w""")
def msg_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts without signatures, an hour of skew and the widest window."""
    rules = config.SecurityConfig(require_signature=False, replay=config.ReplayConfig(window=256, skew_seconds=3600))
    return rules.verified(table(spark, d, "messages")).select("arrival", "verdict")


@query("SELECT 20 AS vectors, 17 AS benign, true AS median_holds, true AS mean_fails")
def gen_attacked_round(spark: SparkSession, d: str) -> DataFrame:
    """A made round with three hostile vectors: the median stays with the benign ones, the mean does not."""
    r = generators.attacked_round(spark, 20, 3, 32, 90.0, seed=5)
    far = lambda df: df.agg(F.max(F.abs(F.col("value") - 1.0))).first()[0]
    args = ("round_id", "pos", "gradients")
    median, mean = far(vectors.coordinate_median(r, *args)), far(vectors.fedavg(r, *args))
    near = F.forall("gradients", lambda x: F.abs(x - 1.0) <= 0.0201)
    return r.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(near).alias("benign"), F.lit(median < 0.03).alias("median_holds"), F.lit(mean > 1).alias("mean_fails"))


@query(f"WITH m AS (SELECT {_PEER} AS peer, arrival, row_number() OVER (PARTITION BY {_PEER} ORDER BY arrival) AS n FROM messages WHERE sender IS NOT NULL AND trim(sender) <> '') SELECT peer, min(arrival) AS first, count(*) FILTER (n <= 50) AS queued, count(*) FILTER (n > 50) AS refused FROM m GROUP BY 1")
def msg_mailbox(spark: SparkSession, d: str) -> DataFrame:
    """A queue of 50 per peer: its first message, how many it holds and how many it refused."""
    m = messages.mailbox(table(spark, d, "messages"), sender_form(F.col("sender")), F.col("arrival"), 50)
    return m.groupBy("peer").agg(F.min("position").alias("first"), F.count_if(F.col("queued")).alias("queued"), F.count_if(~F.col("queued")).alias("refused"))


@query("SELECT round_id, count(DISTINCT sender) AS received, CASE WHEN count(DISTINCT sender) >= 10 THEN 'complete' WHEN round_id % 2 = 0 THEN 'failed' WHEN count(DISTINCT sender) > 0 THEN 'collecting' ELSE 'pending' END AS status FROM updates WHERE round_id IS NOT NULL GROUP BY 1")
def msg_round_status(spark: SparkSession, d: str) -> DataFrame:
    """Rounds that expect ten senders, the even ones past their deadline."""
    u = table(spark, d, "updates").filter("round_id is not null")
    rounds = u.select("round_id").distinct().withColumns({"expected": F.lit(10), "deadline": F.col("round_id") % 2})
    return config.round_status(rounds, u, F.lit(0.5))


@query("SELECT update_id, round_id, CASE WHEN round_id % 3 = 0 THEN true ELSE coalesce(sequence > 100, true) END AS late FROM updates")
def msg_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Updates numbered above 100, or of rounds divisible by 3, which have no deadline, are late."""
    u = table(spark, d, "updates")
    rounds = u.select("round_id").dropna().distinct().filter("round_id % 3 <> 0").withColumn("deadline", F.lit(100))
    return config.in_time(u, rounds, F.col("sequence")).select("update_id", "round_id", "late")


@query("SELECT role, role IN ('coordinator', 'gateway') AS can_aggregate, role IN ('coordinator', 'contributor') AS can_contribute, count(*) AS n FROM (SELECT ['coordinator', 'contributor', 'observer', 'gateway'][1 + node_no % 4] AS role FROM nodes) GROUP BY ALL")
def msg_roles(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("coordinator", "contributor", "observer", "gateway"))), (1 + F.col("node_no") % 4).cast("int"))
    n = messages.peers_by_role(table(spark, d, "nodes").select(role.alias("role")), F.col("role"))
    return n.groupBy("role", "can_aggregate", "can_contribute").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'ring' AS kind, 100 AS links, 100 AS sources UNION ALL SELECT 'star', 99, 99 UNION ALL SELECT 'hierarchical', 99, 99 UNION ALL SELECT 'full_mesh', 9900, 100")
def msg_topologies(spark: SparkSession, d: str) -> DataFrame:
    """Links between a hundred peers."""
    each = [config.Topology(k).edges(spark, 100).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("links"), F.countDistinct("source").alias("sources")) for k in ("ring", "star", "hierarchical", "full_mesh")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("SELECT true AS everyone_reached, true AS within_rounds")
def msg_gossip(spark: SparkSession, d: str) -> DataFrame:
    """Whether a message spread over drawn links reaches all of a thousand peers within the rounds its fan-out allows."""
    spread = messages.gossip(config.Topology("gossip", fanout=4).edges(spark, 1000, seed=3), 0)
    return spread.agg((F.count(F.lit(1)) >= 950).alias("everyone_reached"), (F.max("hops") <= 15).alias("within_rounds"))


@query("SELECT arrival, CASE WHEN ts IS NULL THEN 'missing' WHEN ts < 0 THEN 'before_epoch' WHEN CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END > 4102444800 THEN 'too_far' ELSE 'ok' END AS verdict FROM messages")
def msg_clock_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("arrival", messages.clock_error(whole_seconds(F.col("ts")).cast("long")).alias("verdict"))


@query("SELECT n AS no, CASE WHEN n % 3 = 1 THEN 'invalid_signature' WHEN n % 3 = 2 THEN 'invalid_key' ELSE 'ok' END AS verdict FROM range(60) t(n)")
def msg_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Sixty signed messages, a third of them altered and a third with a key that is no point of the curve, checked."""
    return signatures.samples(spark, 60).select("no", signatures.verdict("public", "message", "signature").alias("verdict"))


@query("SELECT CAST(n AS BIGINT) AS seed, lpad(lower(to_hex(CAST(z AS UBIGINT))), 16, '0') AS first FROM (SELECT n, xor(c, c >> 31) AS z FROM (SELECT n, CAST((CAST(xor(b, b >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS UBIGINT) AS c FROM (SELECT n, CAST((CAST(xor(a, a >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS UBIGINT) AS b FROM (SELECT n, CAST((CAST(n AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS a FROM range(500) t(n)))))")
def gen_split_mix(spark: SparkSession, d: str) -> DataFrame:
    """The first number of each of 500 seeds."""

    def draw(batches):
        for b in batches:
            b["first"] = [f"{int(generators.split_mix(int(s), 1)[0]):016x}" for s in b["seed"]]
            yield b

    return spark.range(500).withColumnRenamed("id", "seed").mapInPandas(draw, "seed long, first string")


# stores
@query("SELECT 'part-' || r_regionkey || '.txt' AS path, sha256(r_name) AS sha256, strlen(r_name) AS bytes, 'hash_mismatch' AS problem FROM region")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files written from the regions, hashed where they lie, against a manifest with wrong hashes."""
    out, rows = _folder(spark, "files"), table(spark, d, "region").select("r_regionkey", "r_name")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in rows.collect():  # a row per region
        to = fs.create(jpath(f"{out}/part-{r['r_regionkey']}.txt"), True)
        to.write(bytearray(r["r_name"].encode()))
        to.close()
    if rows.isEmpty():
        return spark.createDataFrame([], "path string, sha256 string, bytes bigint, problem string")
    found = store.files(spark, out)
    listed = found.select("path", F.lit("00").alias("sha256"), "bytes", F.lit(True).alias("required"))
    return found.join(store.manifest_problems(listed, found, []), "path", "left")


@query(f"SELECT k AS asset_key, fingerprint_v0, trust FROM (SELECT trim(rtrim(lower(trim(asset_key)), '/')) AS k, * FROM registry) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY registered_at DESC, entry_no DESC, fingerprint_v0 DESC, trust DESC) = 1")
def store_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry kept in a store: the oldest entry of each asset appended first, the newest after it, folded again."""
    b = _bundle(spark)
    rows = table(spark, d, "registry").withColumns({"asset_key": asset_form(F.col("asset_key")), "source": F.col("source_desc"), "schema": F.col("schema_desc")}).filter("asset_key is not null")
    from pyspark.sql import types as T

    names = [f.name for f in T._parse_datatype_string(records.REGISTRY)]
    for pick in (F.min_by, F.max_by):
        one = rows.groupBy("asset_key").agg(pick(F.struct(*[n for n in names if n != "asset_key"]), F.struct("registered_at", "entry_no", "fingerprint_v0", "trust")).alias("r"))
        b.append("datasets/registry_updates.ndjson", one.select("asset_key", "r.*"))
    return b.registry().select("asset_key", "fingerprint_v0", "trust")


@query("SELECT DISTINCT lower(trim(input_fingerprint_v0)) AS input_fingerprint_v0, lower(trim(output_fingerprint_v0)) AS output_fingerprint_v0, lower(trim(node_id)) AS node_id FROM lineage")
def store_lineage(spark: SparkSession, d: str) -> DataFrame:
    b = _bundle(spark)
    rows = table(spark, d, "lineage").select(*[plain(F.col(c)).alias(c) for c in ("input_fingerprint_v0", "output_fingerprint_v0", "node_id")], "op_kind")
    b.append("datasets/lineage_edges.ndjson", rows)
    b.snapshot()
    return b.lineage().drop("op_kind")


@query("SELECT count(*) AS rows, CASE WHEN count(*) > 0 THEN 1 END AS first, nullif(count(*), 0) AS last, count(*) AS different, true AS unsafe FROM lineage HAVING count(*) > 0")
def store_materializations(spark: SparkSession, d: str) -> DataFrame:
    """Materialisations of the first version in two appends, numbered from 1 in the order they came."""
    b = _bundle(spark)
    rows = table(spark, d, "lineage")
    for half in (0, 1):
        b.append("datasets/materializations.ndjson", rows.filter(F.pmod("lineage_no", F.lit(2)) == half).select(F.lit(1).alias("schema_version"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("ts_unix_nanos"), F.col("output_fingerprint_v0").alias("asset_key")))
    m = b.materializations()
    return m.agg(F.count(F.lit(1)).alias("rows"), F.min("record_seq").alias("first"), F.max("record_seq").alias("last"), F.countDistinct("record_seq").alias("different"), F.bool_and("unsafe_surface").alias("unsafe")).filter("rows > 0")


def _chain() -> graph.Graph:
    n = lambda key, op, inputs, output, **more: graph.Node(key, op, inputs=tuple(inputs), outputs=(output,), **more)
    return graph.Graph((
        n("d/names", "map", ["ds://kept"], "ds://names", params={"select": ["n_name"]}),
        n("b/kept", "filter_rows", ["ds://nation"], "ds://kept", params={"predicate": "n_regionkey = 1"}),
        n("c/odd", "passthrough", ["ds://open"], "ds://odd"),
        n("e/plug", "passthrough", ["ds://kept"], "ds://plug", execution_trust="unsafe_extension"),
        n("f/lost", "passthrough", ["ds://nowhere"], "ds://lost"),
        n("g/late", "passthrough", ["ds://plug"], "ds://late"),
    ))


def _chain_run(spark: SparkSession, d: str, twice: bool = False) -> Session:
    s = Session(spark, _bundle(spark))
    s.register("ds://nation", table(spark, d, "nation"), "file:///nation.parquet", trust="trusted")
    s.register("ds://open", table(spark, d, "region"), "https://user:pw@host/region.parquet?x=1", trust="untrusted")
    for _ in range(1 + twice):
        s.run(_chain(), permit_all)
    s.finalize()
    return s


_RUN = "(VALUES ('ds://kept', 'filter_rows', 'ok', 'miss', false, 'none'), ('ds://odd', 'passthrough', 'ok', 'miss', true, 'untrusted_input'), ('ds://names', 'map', 'ok', 'miss', false, 'none'), ('ds://plug', 'passthrough', 'ok', 'miss', true, 'unsafe_extension'), ('ds://lost', 'passthrough', 'skipped', 'unknown', false, 'none'), ('ds://late', 'passthrough', 'ok', 'miss', true, 'untrusted_input'))"


@query(f"SELECT * FROM {_RUN} AS r(asset_key, op_type, status, cache_decision, unsafe, reasons)")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline run into a store, verified and read back as a report."""
    run = report.load(spark, _chain_run(spark, d).bundle.root)
    return run.materializations.select("asset_key", "op_type", "status", "cache_decision", F.col("unsafe_surface").alias("unsafe"), identity.joined(F.col("unsafe_reasons")).alias("reasons"))


@query(f"SELECT asset_key, CASE WHEN status = 'ok' THEN 'hit' ELSE 'unknown' END AS decision FROM {_RUN} AS r(asset_key, op_type, status, cache_decision, unsafe, reasons)")
def run_reuse(spark: SparkSession, d: str) -> DataFrame:
    """What the second run of the same graph decides."""
    s = _chain_run(spark, d, twice=True)
    return spark.createDataFrame([(r["asset_key"], r["cache_decision"]) for r in s.records[len(s.records) // 2 :]], "asset_key string, decision string")


@query("SELECT * FROM (VALUES ('ds://nation', 'trusted', true), ('ds://open', 'untrusted', true), ('ds://kept', 'trusted', true), ('ds://odd', 'untrusted', true), ('ds://names', 'trusted', true), ('ds://plug', 'untrusted', true), ('ds://late', 'untrusted', true)) AS t(asset_key, trust, clean)")
def run_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry after a run: trust rolled up from inputs, and sources without secrets."""
    run = report.load(spark, _chain_run(spark, d).bundle.root)
    clean = ~F.coalesce(F.col("source.uri").contains("pw") | F.col("source.uri").contains("?"), F.lit(False))
    return run.registry.select("asset_key", "trust", clean.alias("clean"))


@query("SELECT * FROM (VALUES ('ds://kept', 1), ('ds://names', 1), ('ds://odd', 1), ('ds://plug', 1), ('ds://late', 1)) AS t(asset_key, inputs)")
def run_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of every asset a run made, by the lineage of its store."""
    run = report.load(spark, _chain_run(spark, d).bundle.root)
    made = run.registry.select("asset_key", F.col("fingerprint_v0").alias("output_fingerprint_v0"))
    return run.lineage.join(made, "output_fingerprint_v0").groupBy("asset_key").agg(F.count(F.lit(1)).cast("int").alias("inputs"))


@query("SELECT * FROM (VALUES ('node_skipped', 1), ('node_succeeded', 5)) AS t(what, n)")
def run_events(spark: SparkSession, d: str) -> DataFrame:
    run = report.load(spark, _chain_run(spark, d).bundle.root)
    return run.timeline().filter("kind = 'event'").groupBy(F.split_part(F.col("name"), F.lit("/"), F.lit(2)).alias("what")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('b/kept'), ('c/odd'), ('d/names'), ('e/plug'), ('f/lost'), ('g/late')) AS t(node_key)")
def run_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a graph in the order they run."""
    return spark.createDataFrame([(n.node_key,) for n in _chain().ordered()], "node_key string")


@query("SELECT 'ds://kept' AS asset_key, true AS same UNION ALL SELECT 'ds://names', true")
def run_predicted(spark: SparkSession, d: str) -> DataFrame:
    """Whether fingerprints predicted before a run are those it gives."""
    s = Session(spark)
    s.register("ds://nation", table(spark, d, "nation"), "file:///nation.parquet", trust="trusted")
    rows = []
    for node in [n for n in _chain().ordered() if n.node_key in ("b/kept", "d/names")]:
        df = s.runner(node, [s.frames[k] for k in node.inputs])
        told = s.predict(node, {node.outputs[0]: df.schema.json()})
        s.materialize(node, {node.outputs[0]: df})
        rows += [(k, fp == s.resolve(k)["fingerprint_v0"]) for k, fp in told.items()]
    return spark.createDataFrame(rows, "asset_key string, same boolean")


@query("SELECT lower(trace_id) AS trace_id, lower(span_id) AS span_id, name FROM spans WHERE regexp_full_match(coalesce(trace_id, ''), '[0-9a-fA-F]{32}') AND NOT regexp_full_match(trace_id, '0*') AND regexp_full_match(coalesce(span_id, ''), '[0-9a-fA-F]{16}') AND NOT regexp_full_match(span_id, '0*')")
def run_emitted(spark: SparkSession, d: str) -> DataFrame:
    """The spans within bounds, sent through an emitter into a store and read back."""
    b = _bundle(spark)
    spans = table(spark, d, "spans").filter(records.record_error("span").isNull()).drop("ingested_at")
    store.BundleEmitter(b).spans(spans)
    return b.log("spans.ndjson").select(F.lower("trace_id").alias("trace_id"), F.lower("span_id").alias("span_id"), "name")


# pipelines
@query("WITH e AS (SELECT DISTINCT edge_no, unnest(['from', 'to']) AS side, unnest([from_node_id, to_node_id]) AS raw FROM edges), n AS (SELECT DISTINCT edge_no, side, CASE WHEN trim(raw) <> '' THEN lower(trim(raw)) END AS node_id FROM e) SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE lower(trim(nodes.node_id)) = n.node_id)")
def dag_unknown_ends(spark: SparkSession, d: str) -> DataFrame:
    return graph.unknown_ends(table(spark, d, "nodes"), table(spark, d, "edges"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def dag_passthrough(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark)
    s.register("ds://orders", table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "file:///orders.parquet", trust="trusted")
    s.run(graph.Graph((graph.Node("p", "passthrough", inputs=("ds://orders",), outputs=("ds://same",)),)))
    return s.frames["ds://same"]


@query("SELECT n_nationkey, n_name, n_regionkey, format FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS f(format)")
def dag_formats(spark: SparkSession, d: str) -> DataFrame:
    """The nations written in four formats by one operator and read by another."""
    rows, out, got = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(spark, "formats"), None
    for kind in ("csv", "json", "orc", "parquet"):
        kept = ops.find("persist")({"format": kind, "path": f"{out}/{kind}", "options": {"header": True}}, [rows])
        read = ops.find("ingest")({"format": kind, "path": f"{out}/{kind}", "schema": ", ".join(f"{n} {t}" for n, t in rows.dtypes), "options": {"header": True}}, [])
        part = kept.select(*rows.columns).intersect(read).withColumn("format", F.lit(kind))
        got = part if got is None else got.unionByName(part)
    return got


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def rel_page(spark: SparkSession, d: str) -> DataFrame:
    return ops.find("sort")({"by": ["o_totalprice DESC", "o_orderkey"], "limit": 10, "offset": 5}, [table(spark, d, "orders").select("o_orderkey", "o_totalprice")])


@query("SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def rel_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the views of the same user within an hour."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    both = [e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'").withColumnRenamed("event_id", "other")]
    return ops.find("interval_join")({"keys": ["user_id"], "at": "ts", "before_seconds": 3600, "after_seconds": 3600}, both).select("event_id", "other")


_ASSETS = "CASE WHEN trim(rtrim(lower(trim({0})), '/')) <> '' THEN trim(rtrim(lower(trim({0})), '/')) END"


@query(f"""WITH RECURSIVE reg AS (SELECT {_ASSETS.format('asset_key')} AS k, trust FROM registry QUALIFY row_number() OVER (PARTITION BY {_ASSETS.format('asset_key')} ORDER BY registered_at DESC, entry_no DESC) = 1),
 ins AS (SELECT DISTINCT node_no, {_ASSETS.format('a')} AS k FROM (SELECT node_no, unnest(inputs) AS a FROM nodes)), outs AS (SELECT DISTINCT node_no, {_ASSETS.format('a')} AS k FROM (SELECT node_no, unnest(outputs) AS a FROM nodes)),
 start AS (SELECT node_no FROM nodes WHERE coalesce(execution_trust <> 'core', true) UNION SELECT node_no FROM ins LEFT JOIN reg USING (k) WHERE k IS NOT NULL AND coalesce(trust <> 'trusted', true)),
 steps AS (SELECT DISTINCT outs.node_no AS a, ins.node_no AS b FROM outs JOIN ins USING (k) WHERE k IS NOT NULL),
 bad(node_no) AS (SELECT node_no FROM start UNION SELECT b FROM bad JOIN steps ON a = bad.node_no)
 SELECT DISTINCT node_no, node_no IN (SELECT node_no FROM bad) AS unsafe FROM nodes""")
def dag_trust(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are unsafe, or read, over any number of steps, what an unsafe node makes."""
    r = table(spark, d, "registry").withColumn("asset_key", asset_form(F.col("asset_key")))
    trust = records.latest(r, ["asset_key"], ["registered_at", "entry_no"]).select("asset_key", "trust")
    return graph.trust_rollup(table(spark, d, "nodes"), trust)


@query("SELECT 'r' || r_regionkey AS node_id, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders")
def dag_levels(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and orders as a graph, each on its level."""
    edge = lambda t, a, b, x, y: table(spark, d, t).select(F.concat(F.lit(x), F.col(a)).alias("from_node_id"), F.concat(F.lit(y), F.col(b)).alias("to_node_id"))
    edges = edge("nation", "n_regionkey", "n_nationkey", "r", "n").unionByName(edge("customer", "c_nationkey", "c_custkey", "n", "c")).unionByName(edge("orders", "o_custkey", "o_orderkey", "c", "o"))
    ids = edges.select(F.col("to_node_id").alias("node_id")).unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id")))
    return graph.levels(ids, edges)
