import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fedlens.common import clean, shared_dir, staged
from fedlens.functions import identity, signatures
from fedlens.operators import messages, records
from fedlens.plans import graph, ops


def test_published_signature_vectors():
    # first two test vectors of RFC 8032, section 7.1
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signed = "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert signatures.public_key(seed).hex() == public and signatures.sign(seed, b"").hex() == signed
    assert signatures.checked(bytes.fromhex(public), b"", bytes.fromhex(signed)) == "ok"
    other = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert signatures.public_key(other).hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"


def test_signatures_that_must_not_pass(spark):
    seed = b"\1" * 32
    key, good = signatures.public_key(seed), signatures.sign(seed, b"m")
    late = good[:32] + (int.from_bytes(good[32:], "little") + signatures.ORDER).to_bytes(32, "little")
    rows = [(key, b"m", good), (key, b"n", good), (key, b"m", late), (key, b"m", good[:40]), (key, None, good), (key, b"m", None), (None, b"m", good), (b"\0" * 32, b"m", good), (b"short", b"m", good)]
    df = spark.createDataFrame(rows, "p binary, m binary, s binary")
    assert [r[0] for r in df.select(signatures.verdict("p", "m", "s")).collect()] == ["ok"] + ["invalid_signature"] * 4 + ["missing_signature"] + ["invalid_key"] * 3
    assert [r[0] for r in df.select(signatures.on_curve("p")).collect()] == [True] * 6 + [False] * 3
    with pytest.raises(ValueError):
        signatures.public_key(b"\0" * 32)


def test_mailbox_weights_and_clock(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), at) for at in range(0, 900_000, 1500)]
    got = messages.mailbox(spark.createDataFrame(rows, "p string, at long"), F.col("p"), F.col("at"), 40).collect()
    for peer in "ab":
        own = sorted(at for p, at in rows if p == peer)
        assert sorted(r["position"] for r in got if r["peer"] == peer and r["queued"]) == own[:40] and sum(r["peer"] == peer for r in got) == len(own)
    votes = spark.createDataFrame([(1, True, 5), (1, False, 2), (1, None, 1), (2, False, 0)], "r int, yes boolean, w int")
    assert sorted(map(tuple, messages.quorum(votes, "r", F.col("yes"), 0.6, F.col("w")).collect())) == [(1, 3, 8, 5, True), (2, 1, 0, 0, False)]
    assert sorted(map(tuple, messages.quorum(votes, "r", F.col("yes")).collect())) == [(1, 3, 1, False), (2, 1, 0, False)]
    t = spark.createDataFrame([(None,), (-1,), (0,), (10**12,)], "t long")
    assert [r[0] for r in t.select(messages.clock_error(F.col("t"))).collect()] == ["missing", "before_epoch", "ok", "too_far"]


def test_gossip_counts_rounds_and_ends_on_loops(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (9, 8), (None, 4)], "source long, target long")
    assert sorted(map(tuple, messages.gossip(links, 0).collect())) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_histograms_counters_and_gauges(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 1.0), ("a", 3, 2.0), ("b", 1, None)], "n string, t long, v double")
    assert sorted(map(tuple, records.histogram(df.dropna(), ["n"], "v", [1.0, 4.0]).collect())) == [("a", 0, 1, 1.0), ("a", 1, 1, 2.0), ("a", 2, 1, 5.0)]
    assert sorted(map(tuple, records.counters(df, ["n"], "v").collect())) == [("a", 3, 8.0), ("b", 0, None)]
    assert sorted(map(tuple, records.gauges(df, ["n"], "t", "v").collect())) == [("a", 3, 2.0), ("b", 1, None)]


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(6)
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    left = [(rng.choice("xy"), at(rng.randrange(500)), i) for i in range(60)]
    right = [(rng.choice("xyz"), at(rng.randrange(500)), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, t timestamp, l int"), spark.createDataFrame(right, "k string, t timestamp, r int")
    got = sorted((r["l"], r["r"]) for r in ops.find("interval_join")({"keys": ["k"], "at": "t", "before_seconds": 10, "after_seconds": 25}, [a, b]).collect())
    assert got == sorted((p[2], q[2]) for p in left for q in right if p[0] == q[0] and -10 <= (q[1] - p[1]).total_seconds() <= 25)


def test_sources_sinks_pages_and_names(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i % 3}", "a,b") for i in range(9)], "i int, part string, t string")
    for kind in ("csv", "json", "orc", "parquet"):
        where = {"format": kind, "path": f"file://{tmp_path}/{kind}", "options": {"header": True}}
        back = ops.find("persist")({**where, "by": ["part"]}, [df])
        read = ops.find("ingest")({**where, "schema": "i int, part string, t string"}, [])
        assert sorted(map(tuple, back.select("i", "part", "t").collect())) == sorted(map(tuple, read.select("i", "part", "t").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ops.OpError):
        ops.find("ingest")({}, [df])
    assert [r["i"] for r in ops.find("sort")({"by": ["i DESC"], "limit": 2, "offset": 3}, [df]).collect()] == [5, 4]
    ops.find("publish")({"name": "published_rows"}, [df])
    assert spark.sql("SELECT count(*) AS n FROM published_rows").first()["n"] == 9


def test_trust_rolls_up_over_steps_and_loops(spark):
    rows = [(1, "core", ["raw"], ["a"]), (2, "core", ["a"], ["b"]), (3, "core", ["B/ "], ["c"]), (4, "core", ["good"], ["d"]), (5, "unsafe_extension", [], ["e"]), (6, "core", ["f", "e"], ["g"]), (7, "core", ["g"], ["f"])]
    nodes = spark.createDataFrame(rows, "node_no long, execution_trust string, inputs array<string>, outputs array<string>")
    trust = spark.createDataFrame([("raw", "untrusted"), *[(k, "trusted") for k in "abcdefg"], ("good", "trusted")], "asset_key string, trust string")
    assert {r["node_no"] for r in graph.trust_rollup(nodes, trust).collect() if r["unsafe"]} == {1, 2, 3, 5, 6, 7}


def test_fallback_run_ids():
    assert identity.fallback_run_id("a", 1) == identity.fallback_run_id("a", 1) != identity.fallback_run_id("a", 2)
    assert len(identity.fallback_run_id()) == 32


def test_staged_tables_can_be_deleted(spark):
    kept = staged(spark.range(3), "test")
    path = kept.inputFiles()[0]
    assert path.startswith("file:") and shared_dir(spark).split(":")[-1].lstrip("/") in path
    assert clean(spark) >= 1 and clean(spark) == 0
    with pytest.raises(Exception, match="(?i)not.?exist|path"):
        kept.collect()


def test_aggregators_of_ones_own_and_emitters(spark):
    from fedlens.operators import vectors as V
    from fedlens.sources import store

    V.register_aggregator("first", lambda df, r, s, v: V.long_form(df, r, s, v).groupBy("round", "i").agg(F.min_by("value", "sender").alias("value")), 0.1)
    try:
        df = spark.createDataFrame([(1, 2, [5.0, 6.0]), (1, 1, [7.0, 8.0])], "r long, s long, v array<float>")
        assert V.pipeline(df, "r", "s", "v", "first").first()["vec"] == [7.0, 8.0]
        for bad in (("first", 0.1), ("", 0.1), ("new", 0.9)):
            with pytest.raises(ValueError):
                V.register_aggregator(bad[0], V.fedavg, bad[1])
    finally:
        del V.AGGREGATORS["first"]

    class Kept(store.Emitter):
        def __init__(self):
            self.got = []

        def emit(self, log, rows):
            self.got.append((log, len(rows)))

    kept = Kept()
    kept.spans([{}])
    kept.metrics([{}, {}])
    assert kept.got == [("spans.ndjson", 1), ("metrics.ndjson", 2)]


def test_unknown_ends_of_edges(spark):
    nodes = spark.createDataFrame([("A ",), ("b",), (None,)], "node_id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, " B", "c"), (3, None, " ")], "edge_no long, from_node_id string, to_node_id string")
    assert sorted(map(tuple, graph.unknown_ends(nodes, edges).collect()), key=repr) == [(2, "to", "c"), (3, "from", None), (3, "to", None)]


def test_streams_from_and_to_any_place(spark, tmp_path):
    from fedlens.streaming import messages as live

    stream = live.received(spark, "rate-micro-batch", rowsPerBatch=20, numPartitions=2)
    assert stream.isStreaming and stream.columns == ["timestamp", "value"]
    spark.range(30).write.parquet(str(tmp_path / "in"))
    files = live.received(spark, "parquet", "id long", path=str(tmp_path / "in"))
    live.sent(files, "parquet", str(tmp_path / "state"), path=str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
