import numpy as np
import pytest
from pyspark.sql import functions as F

from fedlens.functions import identity as I
from fedlens.operators import closure, records
from fedlens.plans import graph as G
from fedlens.plans import ops, report
from fedlens.plans.session import Session, permit_all, plain_uri
from fedlens.sources import store

RUN = "0123456789abcdef" * 2


def node(key, op="passthrough", inputs=(), outputs=(), **k):
    return G.Node(key, op, inputs=tuple(inputs), outputs=tuple(outputs), **k)


def numbers(spark, n=10):
    return spark.range(n).withColumn("v", F.col("id") * 2)


def test_order_is_by_edges_then_key():
    b, a, c = node("b", outputs=["x"]), node("a", inputs=["x"]), node("c")
    assert [n.node_key for n in G.Graph((b, a, c)).ordered()] == ["b", "a", "c"]
    assert [n.node_key for n in G.Graph((b, a, c)).ordered(strict_edges=True)] == ["a", "b", "c"]
    ids = {n.node_key: n.normalised().node_id for n in (a, b, c)}
    twice = (G.Edge(ids["c"], ids["a"]), G.Edge(ids["c"], ids["a"]))
    assert [n.node_key for n in G.Graph((b, a, c), twice).ordered(strict_edges=True)] == ["b", "c", "a"]


def test_graph_errors():
    a, b, c = node("a"), node("b"), node("c")
    i = lambda n: n.normalised().node_id
    for bad, code in (
        (G.Graph((a, b, c), (G.Edge(i(a), i(b)), G.Edge(i(b), i(a)), G.Edge(i(b), i(c)))), "cycle_detected"),
        (G.Graph((a,), (G.Edge(i(a), i(a)),)), "cycle_detected"),
        (G.Graph((a, a)), "duplicate_node_key"),
        (G.Graph((G.Node("a", "x", node_id="1"), G.Node("b", "x", node_id="1"))), "duplicate_node_id"),
        (G.Graph((a,), (G.Edge(i(a), "nope"),)), "unknown_endpoint"),
        (G.Graph((node("k" * 257),)), "node_key_too_long"),
        (G.Graph((node("a", "t" * 129),)), "op_type_too_long"),
        (G.Graph((node("a", inputs=["x"] * 257),)), "too_many_inputs"),
    ):
        with pytest.raises(G.GraphError) as e:
            bad.ordered()
        assert e.value.code == code
    with pytest.raises(G.GraphError) as e:
        G.Graph((a, b, c), (G.Edge(i(a), i(b)), G.Edge(i(b), i(a)), G.Edge(i(b), i(c)))).ordered()
    assert e.value.about == ("a", "b", "c")


def test_hashes_include_what_they_should():
    base = node("a", inputs=["x"], params={"p": 1}).normalised()
    assert node("a", inputs=["x"], params={"p": 1}, execution_trust="unsafe_extension").normalised().node_def_hash == base.node_def_hash
    moved = node("a", inputs=["y"], params={"p": 1}).normalised()
    assert moved.op_hash == base.op_hash and moved.node_def_hash != base.node_def_hash
    assert node("prep/clean_users").normalised().node_id == "1325e6a3bb11efd3cacbcafdcdae340b"


def test_run_with_denied_failed_and_skipped_nodes(spark):
    s = Session(spark)
    s.register("raw", numbers(spark), "file:///raw.parquet", trust="trusted")
    done = s.run(G.Graph((node("one", "filter_rows", ["raw"], ["a"], params={"predicate": "v > 4"}), node("two", "union", ["a", "raw"], ["b"]), node("bad", "unsupported_op", ["raw"], ["c"]), node("after", "passthrough", ["c"], ["d"]), node("risky", "passthrough", ["raw"], ["e"], execution_trust="unsafe_extension"), node("zero", "map", ["raw"], ["f"], params={"select": ["nope"]}))), eager=True)
    assert done.succeeded == ["one", "two"] and done.failed == ["bad", "risky", "zero"] and done.skipped == ["after"]
    assert s.frames["b"].count() == 17 and "c" not in s.registry and "e" not in s.registry
    codes = {r["asset_key"]: (r["status"], r.get("error_code") or "") for r in s.records}
    assert codes["a"] == ("ok", "") and codes["d"] == ("skipped", "missing_input:c") and codes["e"] == ("error", "policy_denied:unsafe_extension") and codes["c"] == ("error", "runner_error:unsupported_op:unsupported_op") and codes["f"][1].startswith("runner_error:")
    assert [r["rows"] for r in s.records if r["asset_key"] == "b"] == [17]
    assert {e["name"] for e in s.events} == {f"scheduler/node_{x}" for x in ("denied", "skipped", "failed", "succeeded")}


def test_trust_prediction_reuse_and_contract(spark):
    s = Session(spark)
    s.register("raw", numbers(spark), "s3://alice:secret@bucket/path/file.parquet?part=1")
    assert s.registry["raw"]["source"]["uri"] == "s3://<redacted>@bucket/path/file.parquet" == plain_uri("s3://alice:secret@bucket/path/file.parquet#x")
    one = node("one", inputs=["raw"], outputs=["a"])
    want = s.predict(one, {"a": s.frames["raw"].schema.json()})
    assert not s.cached("a", want["a"])
    s.applied("clip")
    s.run(G.Graph((one,)))
    assert s.registry["a"]["fingerprint_v0"] == want["a"] and s.registry["a"]["trust"] == "untrusted" and s.cached("a", want["a"]) and not s.cached("raw", want["a"])
    assert s.records[0]["unsafe_reasons"] == ["untrusted_input", "unsafe_extension"] and s.records[0]["applied_transforms"][0]["transform_name"] == "clip"
    again = s.run(G.Graph((one,)))
    assert again.reused == ["one"] and s.records[1]["cache_decision"] == "hit" and s.records[1]["applied_transforms"] == [] and len(s.lineage) == 1
    before = dict(s.registry)
    for outputs in ({}, {"a": s.frames["raw"], "z": s.frames["raw"]}, [("a", s.frames["raw"])] * 2):
        with pytest.raises(ValueError):
            s.materialize(one, outputs)
    with pytest.raises(ValueError):
        s.predict(node("x", inputs=["gone"], outputs=["y"]), {"y": "{}"})
    assert s.registry == before
    old = s.registry["raw"]["fingerprint_v0"]
    s.run(G.Graph((node("self", inputs=["raw"], outputs=["raw"]),)), policy=permit_all)
    assert s.lineage[-1]["input_fingerprint_v0"] == old != s.registry["raw"]["fingerprint_v0"]


def test_more_operators(spark):
    df = numbers(spark)
    get = lambda op, p, *i: ops.find(op)(p, list(i))
    assert get("join", {"on": "id"}, df, df.select("id")).count() == 10 and get("distinct", {}, df.union(df)).count() == 10
    parts = get("split", {"keys": ["id"], "parts": {"train": 8, "test": 2}}, df)
    assert {r["part"] for r in parts.collect()} <= {"train", "test"} and parts.collect() == get("split", {"keys": ["id"], "parts": {"train": 8, "test": 2}}, df).collect()
    assert get("sample", {"keys": ["id"], "share": 1.0}, df).count() == 10
    assert get("stats", {"columns": ["v"]}, df).first()[:] == ("v", 10, 0, 0.0, 18.0, 9.0)
    assert get("validate", {"checks": ["v >= 0"]}, df).count() == 10
    with pytest.raises(Exception, match="check failed"):
        get("validate", {"checks": ["v > 0"]}, df).collect()
    assert get("redact", {"columns": ["s"]}, spark.createDataFrame([("Ab1",)], "s string")).first()[0] == "Xxn"
    assert get("aggregate", {"grouping": "cube", "by": ["id"], "aggregates": {"n": "count(*)"}}, df).count() == 11
    assert [r["id"] for r in get("sort", {"by": ["v DESC"], "limit": 2}, df).collect()] == [9, 8]
    assert get("intersect", {}, df, df.limit(3)).count() == 3 and get("except", {"all": True}, df.union(df), df).count() == 10
    left, right = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int"), spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t int, w string")
    assert sorted(map(tuple, get("as_of_join", {"keys": ["k"], "at": "t", "take": ["w"]}, left, right).collect()), key=repr) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    with pytest.raises(ops.OpError):
        get("passthrough", {}, df, df)


def test_bundle_report_and_tampering(spark, tmp_path):
    b = store.Bundle.create(spark, f"file://{tmp_path}", RUN)
    assert b.problems() == []
    for bad in ("0" * 32, "xyz"):
        with pytest.raises(store.StoreError):
            store.Bundle.create(spark, f"file://{tmp_path}", bad)
    with pytest.raises(store.StoreError):
        store.Bundle.create(spark, f"file://{tmp_path}", RUN)
    s = Session(spark, b, snapshot_every=2)
    s.register("raw<1>", numbers(spark), "file:///raw.parquet")
    s.run(G.Graph((node("one", "passthrough", ["raw<1>"], ["a"]), node("two", "passthrough", ["gone"], ["z"]))))
    b.append("spans.ndjson", [{"schema_version": 1, "trace_id": "a" * 32, "span_id": "b" * 16, "name": "op", "start_unix_nanos": 1_000_000, "end_unix_nanos": 5_999_999, "attrs": {"k": "v"}}])
    with pytest.raises(store.StoreError, match="name_too_long"):
        b.append("metrics.ndjson", [{"name": "n" * 257, "value": 1.0}])
    b.write("graph.json", {"nodes": [{"node_key": "one", "node_id": "1", "execution_trust": "core", "inputs": ["raw<1>"]}, {"node_key": "sum", "node_id": "2"}], "edges": [{"from_node_id": "1", "to_node_id": "2"}, {"from_node_id": "1", "to_node_id": "9"}]})
    s.finalize()
    run = report.load(spark, b.root)
    assert run.warnings == [] and [r["asset_key"] for r in run.registry.collect()] == ["a", "raw<1>"] and run.lineage.count() == 1
    assert [(r["asset_key"], r["status"]) for r in run.materializations.collect()] == [("a", "ok"), ("z", "skipped")]
    assert run.unsafe_nodes() == ["one"] and {r["kind"] for r in run.timeline().collect()} == {"event", "span", "materialization"}
    page = report.html(run)
    assert "raw&lt;1&gt;" in page and "duration_ms=4" in page and page.count("<line") == 1
    assert len(report.as_json(run)["materializations"]) == 2
    # logs alone give the same as snapshots and logs
    registry = run.registry.collect()
    b.write("datasets/registry.json", {"schema_version": 1, "datasets": [{"asset_key": "old"}]})
    with pytest.raises(store.StoreError, match="datasets/registry.json"):
        report.load(spark, b.root)
    b.finalize()
    again = report.load(spark, b.root)
    assert len(again.warnings) == 1 and again.registry.collect() == registry


def test_later_appends_win_whatever_their_partitions(spark, tmp_path):
    b = store.Bundle.create(spark, f"file://{tmp_path}", RUN)
    entry = lambda trust: spark.range(40).selectExpr("concat('k', id) as asset_key", "'f' as fingerprint_v0", f"'{trust}' as trust")
    b.append("datasets/registry_updates.ndjson", entry("trusted").repartition(4))
    b.append("datasets/registry_updates.ndjson", entry("untrusted").repartition(3))
    other = store.Bundle.open(spark, b.root)
    other.append("datasets/registry_updates.ndjson", [{"asset_key": "k7", "fingerprint_v0": "g", "trust": "trusted"}, {"asset_key": "k7", "fingerprint_v0": "h", "trust": "trusted"}])
    got = {r["asset_key"]: (r["trust"], r["fingerprint_v0"]) for r in b.registry().collect()}
    assert len(got) == 40 and got.pop("k7") == ("trusted", "h") and set(got.values()) == {("untrusted", "f")}
    b.snapshot()
    b.append("datasets/registry_updates.ndjson", entry("trusted").repartition(2))
    assert {r["trust"] for r in b.registry().collect()} == {"trusted"} and b.snapshot_warning() is None


def test_old_materialisations_are_numbered_in_the_order_they_came(spark, tmp_path):
    b = store.Bundle.create(spark, f"file://{tmp_path}", RUN)
    old = lambda lo, hi: spark.range(lo, hi, 1, 3).selectExpr("1 as schema_version", "id as ts_unix_nanos", "concat('k', id) as asset_key", "true as cache_hit")
    b.append("datasets/materializations.ndjson", old(0, 10))
    b.append("datasets/materializations.ndjson", [{"schema_version": 1, "ts_unix_nanos": 10, "asset_key": "k10"}])
    rows = b.materializations().collect()
    assert [r["record_seq"] for r in rows] == list(range(1, 12)) and [r["asset_key"] for r in rows] == [f"k{i}" for i in range(11)]
    assert rows[0]["cache_decision"] == "hit" and rows[0]["unsafe_reasons"] == ["missing_provenance"]
    text = "".join(p.read_text() for p in (tmp_path / RUN / "datasets/materializations.ndjson").glob("part*"))
    assert "unsafe_reasons" not in text  # empty fields are left out


def test_a_write_that_fails_leaves_nothing_behind(spark, tmp_path):
    b = store.Bundle.create(spark, f"file://{tmp_path}", RUN)
    s = Session(spark, b)
    s.register("raw", numbers(spark), "file:///raw.parquet")
    two = G.Node("two", "passthrough", inputs=("raw",), outputs=("a", "b"))
    append = b.append

    def failing(name, rows):
        append(name, rows)
        if name == "datasets/lineage_edges.ndjson":
            raise OSError("disk full")

    b.append = failing
    with pytest.raises(OSError):
        s.materialize(two, {"a": numbers(spark), "b": numbers(spark)})
    b.append = append
    assert sorted(s.registry) == ["raw"] and s.records == [] and s.lineage == [] and s.seq == 0
    assert [r["asset_key"] for r in b.registry().collect()] == ["raw"] and b.lineage().count() == 0 and b.materializations().count() == 0
    s.materialize(two, {"a": numbers(spark), "b": numbers(spark)})
    assert [r["record_seq"] for r in b.materializations().collect()] == [1, 2] and b.lineage().count() == 2


def test_links_out_of_a_bundle_and_large_files(spark, tmp_path):
    b = store.Bundle.create(spark, f"file://{tmp_path}", RUN)
    (tmp_path / "outside.json").write_text("{}")
    (tmp_path / RUN / "inside.json").symlink_to(tmp_path / "outside.json")
    b.finalize()
    assert ("inside.json", "bad_path") in b.problems()
    whole, pieces = (sorted(map(tuple, store.files(spark, b.root, n).collect())) for n in (1 << 20, 10))
    assert whole == pieces and len(whole) > 8


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k":"x","v":1}\n\n{"k":\n{"k":"x","v":2}\nnothing\n')
    assert [r["line_no"] for r in store.bad_lines(spark, f"file://{tmp_path}/a.json", "k string, v int").orderBy("line_no").collect()] == [3, 5]


def test_manifest_problems(spark):
    listed = spark.createDataFrame([("a", "AA", 1, True), ("a", "AA", 1, True), ("b", "bb", 2, True), ("c", "cc", 3, True), ("../d", "x", 1, False), ("/e", "x", 1, False), ("f", "x", 1, True), ("g", "x", 1, False)], store.MANIFEST)
    found = spark.createDataFrame([("a", "aa", 1), ("b", "xx", 2), ("c", "cc", 9), ("more", "x", 1)], "path string, sha256 string, bytes bigint")
    got = sorted(set(map(tuple, store.manifest_problems(listed, found, ["a", "need"]).collect())))
    assert got == [("../d", "bad_path"), ("/e", "bad_path"), ("a", "duplicate_path"), ("b", "hash_mismatch"), ("c", "size_mismatch"), ("f", "missing_file"), ("need", "required_not_listed")]


def test_line_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k":"x","v":1}\n\n{"k":"x","v":2}\n')
    rows = store.read_ordered_lines(spark, f"file://{tmp_path}/a.json", "k string, v int")
    assert [(r["line_no"], r["v"]) for r in rows.orderBy("line_no").collect()] == [(1, 1), (3, 2)]
    assert records.latest(rows.select("k", "v", "line_no"), ["k"], ["line_no"]).first()["v"] == 2
    (tmp_path / "b.json").write_text('{"k":"x"}\n{"k":\n')
    with pytest.raises(Exception):
        store.read_lines(spark, f"file://{tmp_path}/b.json", "k string, v int").collect()


def test_versions_bounds_and_attributes(spark):
    v1 = '{"schema_version":1,"ts_unix_nanos":5,"asset_key":"a","cache_hit":true}'
    v2 = '{"schema_version":2,"record_seq":7,"asset_key":"b","op_type":"map","unsafe_surface":false,"cache_decision":"miss"}'
    raw = spark.createDataFrame([(0, v1), (1, v2)], "pos long, j string").select("pos", F.from_json("j", records.MATERIALIZATION).alias("r")).select("pos", "r.*")
    a, b = sorted(records.to_v2(raw, F.col("pos")).collect(), key=lambda r: r["asset_key"])
    assert (a["record_seq"], a["op_type"], a["unsafe_surface"], a["unsafe_reasons"], a["cache_decision"]) == (1, "unknown", True, ["missing_provenance"], "hit")
    assert (b["record_seq"], b["op_type"], b["unsafe_surface"], b["applied_transforms"], b["cache_hit"]) == (7, "map", False, [], False)
    spans = spark.createDataFrame([("a" * 32, "b" * 16, "n", {}), ("0" * 32, "b" * 16, "n", {}), ("A" * 32, "b", "n", {}), ("a" * 32, "b" * 16, "ü" * 129, {}), ("a" * 32, "b" * 16, "n", {str(i): "" for i in range(65)}), ("a" * 32, "b" * 16, "n", {"k" * 129: ""}), ("a" * 32, "b" * 16, "n", {"k": "v" * 1025})], "trace_id string, span_id string, name string, attrs map<string,string>")
    assert [r[0] for r in spans.select(records.record_error("span")).collect()] == [None, "invalid_trace_id", "invalid_span_id", "name_too_long", "too_many_attrs", "attr_key_too_long", "attr_value_too_long"]
    one = spark.createDataFrame([({"n": "5", "s": "x"},)], "m map<string,string>")
    assert one.select(records.attr(F.col("m"), "n", "int"), records.attr(F.col("m"), "s", "int"), records.attr(F.col("m"), "q")).first()[:] == (5, None, None)
    kinds = spark.createDataFrame([(j,) for j in ("null", "true", "1", "1.5", '"x"', "[1]", '{"a":1}')], "j string")
    assert [r[0] for r in kinds.select(records.value_kind(F.parse_json("j"))).collect()] == ["null", "bool", "int", "float", "string", "array", "object"]


def test_quality(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, None), ("b", 1, 1)], "k string, x int, y int")
    assert sorted(map(tuple, records.quality(df, ["k"], ["x", "y"]).collect())) == [("a", 2, 0.5), ("b", 1, 0.0)]
    history = spark.createDataFrame([("d", 1, 10, "s"), ("d", 2, 7, "s"), ("d", 3, 9, "t")], "k string, seq int, rows long, schema_hash_v0 string")
    assert sorted((r["seq"], r["row_count_delta"], r["schema_changed"]) for r in records.quality_changes(history, "k", "seq").collect()) == [(1, None, None), (2, -3, False), (3, 2, True)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  ÄB c ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(I.ascii_lower(F.col("s"))).collect()] == ["Äb c", "", None]
    uris = spark.createDataFrame([("s3://a:b@c@host/p?x#y",), ("plain/path#f",), ("http://h/a@b",)], "u string")
    assert [r[0] for r in uris.select(I.clean_uri(F.col("u"))).collect()] == ["s3://<redacted>@host/p", "plain/path", "http://h/a@b"]
    row = spark.range(1).select(I.escaped_html(F.lit("<a b=\"c\">&'")), I.joined(F.array(F.lit("x"), F.lit("y"))), I.joined(F.array().cast("array<string>")), I.shown(F.lit(None)), I.auth_marker(F.lit("custom"), F.lit("k")), I.relative_path(F.lit("/base\\x/y"), F.lit("/base")), I.valid_id(F.lit("0" * 16), 16)).first()
    assert row[:] == ("&lt;a b=&quot;c&quot;&gt;&amp;&#39;", "x,y", "none", "?", "custom:k", "x/y", False)
    a = spark.range(1).select(I.sha256(F.lit("ab"), F.lit("c")), I.sha256(F.lit("a"), F.lit("bc")), I.sha256(F.lit(""), F.lit(None)), I.sha256(F.lit(None), F.lit(""))).first()
    assert len(set(a)) == 4


def test_levels_and_closure(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdxy"], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "from_node_id string, to_node_id string")
    assert sorted(map(tuple, G.levels(nodes, edges).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
    pairs = closure.closure(edges, "from_node_id", "to_node_id")
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "c"), ("b", "c"), ("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]
    chain = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(20)], "s string, t string")
    assert closure.closure(chain, "s", "t").count() == 210
    assert closure.closure(chain.limit(0), "s", "t").count() == 0


def test_ancestors_are_counted_without_a_row_per_pair(spark, tmp_path, monkeypatch):
    from fedlens import common
    from fedlens.plans import catalogue

    n = 1_000
    chain = [(f"{i:04}", f" {i + 1:04} ".upper(), "x") for i in range(n)] * 2 + [("0007", None, "x"), (" ", "0007", "x")]
    spark.createDataFrame(chain, "input_fingerprint_v0 string, output_fingerprint_v0 string, node_id string").write.parquet(f"{tmp_path}/lineage.parquet")
    paths = []
    monkeypatch.setattr(common, "_STAGED", paths)
    got = dict(map(tuple, catalogue.ext_lineage_closure(spark, str(tmp_path)).collect()))
    assert got == {f"{i:04}": i for i in range(1, n + 1)}
    assert sum(spark.read.parquet(x).count() for x in paths) <= 10 * n  # the chain has 500,500 pairs
    common.clean(spark)


def test_ancestor_counts_with_loops_in_blocks_and_components(spark):
    import random

    draw = random.Random(5)
    links = [(g * 100 + draw.randrange(12), g * 100 + draw.randrange(12)) for g in range(6) for _ in range(4 + 3 * g)]
    links += [(700, 700), (701, 701), (701, 702)] + [(800 + i, 801 + i) for i in range(15)] + [(810, 805), (812, 803)]
    edges = spark.createDataFrame([*links, *links[:9], (None, 3), (3, None)], "s long, t long")
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    want = {}
    for a in after:
        found, ahead = set(), [*after[a]]
        while ahead:
            b = ahead.pop()
            if b not in found:
                found.add(b)
                ahead += after.get(b, ())
        for b in found:
            want[b] = want.get(b, 0) + 1
    source, target = (np.array(x, dtype=np.int64) for x in zip(*sorted(set(links))))
    order = closure.ordered(source, target)
    for bits in (1, 3, 7, 64):  # blocks that end within loops
        total = closure.counted(order, range(-(-int(order.bit[-1]) // bits)), bits)[order.part]
        assert {int(i): int(x) for i, x in zip(order.ids, total) if x} == want
    for most in (closure.MOST, 16, 0):  # all at once; components in tasks and, above 16 edges, by pairs; all by pairs
        assert dict(map(tuple, closure.ancestor_counts(edges, "s", "t", most=most, held=1).collect())) == want
    for most in (closure.MOST, -1):
        assert closure.ancestor_counts(edges.limit(0), "s", "t", most=most).count() == 0


def test_formats_round_trip(spark, tmp_path):
    df = numbers(spark)
    for fmt in ("parquet", "orc", "json", "csv"):
        path = f"file://{tmp_path}/{fmt}"
        df.write.format(fmt).option("header", True).save(path)
        back = spark.read.format(fmt).option("header", True).schema(df.schema).load(path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_the_example_runs(spark, tmp_path):
    from pathlib import Path

    from examples import pipeline

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    page = Path(pipeline.main("/root/testdata/sf0.001", str(tmp_path))).read_text()
    assert "dataset://sums" in page and "Unsafe nodes</h2><ul><li>none" in page
