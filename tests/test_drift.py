import datetime as dt
import json

from fedlens.operators import drift

T = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
SCHEMA = "file_name string, record_kind string, producer string, written_at timestamp, line_no int, body string, field string, type string"


def frame(spark, files):
    rows = []
    for name, producer, hour, bodies in files:
        rows += [(name, "span", producer, T(hour), i, b if isinstance(b, str) or b is None else json.dumps(b), "f", "t") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def run(df):
    return sorted((r.file_name, r.change_kind, r.field_name, r.new_name) for r in drift.changes(df).collect())


HEX = lambda i: f"{i * 7919:016x}"


def test_added_removed_retyped_renamed(spark):
    f1 = [{"id": HEX(i), "n": i * 1000, "status": ["ok", "error"][i % 2], "flag": True} for i in range(20)]
    f2 = [{"ident": HEX(i + 50), "n": str(i * 1000), "status": ["ok", "error"][i % 2], "size": 1.5} for i in range(20)]
    f3 = [{"ident": HEX(i), "n": "7", "size": 1.5, "color": ["red", "blue"][i % 2]} for i in range(20)]
    # read out of order, with broken, empty, null, non-object and repeated lines, and fields left out or null in some
    df = frame(spark, [("c", "p", 3, f3), ("a", "p", 1, [*f1, {}, {"n": None}, '{"id": "x', "", None, "[1]", json.dumps(f1[0]), '{"n": 1, "n": 2}']), ("b", "p", 2, [*f2, {"flag": None}])])
    assert run(df) == [("b", "added", "size", ""), ("b", "removed", "flag", ""), ("b", "renamed", "id", "ident"), ("b", "retyped", "n", ""), ("c", "added", "color", ""), ("c", "removed", "status", "")]


def test_two_renames_of_like_content_go_by_name(spark):
    f1 = [{"span_id": HEX(i), "parent_span_id": HEX(i + 9)} for i in range(10)]
    f2 = [{"spanId": HEX(i), "parentSpan": HEX(i + 9)} for i in range(10)]
    assert run(frame(spark, [("a", "p", 1, f1), ("b", "p", 2, f2)])) == [("b", "renamed", "parent_span_id", "parentSpan"), ("b", "renamed", "span_id", "spanId")]


def test_producers_are_apart_and_versions_are_no_change(spark):
    df = frame(spark, [("a", "p", 1, [{"schema_version": 1, "x": 1}]), ("b", "q", 2, [{"y": 1}]), ("c", "p", 3, [{"schema_version": 2, "x": 2}]), ("d", "p", 4, [{"schema_version": 2, "x": 2.5}, {"x": 3}])])
    assert run(df) == [("d", "retyped", "x", "")]


def test_whole_file_broken(spark):
    assert run(frame(spark, [("a", "p", 1, [{"x": 1}]), ("b", "p", 2, ["{"]), ("c", "p", 3, [{"x": 1}])])) == [("b", "removed", "x", ""), ("c", "added", "x", "")]


def test_unified_table(spark):
    f1 = [{"id": HEX(i), "n": i, "tags": ["a"]} for i in range(12)]
    f2 = [{"ident": HEX(i), "n": i + 0.5, "tags": ["a"]} for i in range(12)]
    out = drift.unified(frame(spark, [("a", "p", 1, f1), ("b", "p", 2, [*f2, "broken"])]), "span")
    assert out.dtypes == [("source_file", "string"), ("source_line", "int"), ("id", "string"), ("n", "double"), ("tags", "string")]
    rows = sorted(map(tuple, out.collect()))
    assert len(rows) == 24 and rows[0] == ("a", 0, HEX(0), 0.0, '["a"]') and rows[12] == ("b", 0, HEX(0), 0.5, '["a"]')


def test_empty_and_long(spark):
    assert run(frame(spark, [])) == []
    long = [{"t": "word " * 200_000}]
    assert run(frame(spark, [("a", "p", 1, long), ("b", "p", 2, long)])) == []
    assert drift.unified(frame(spark, []), "span").columns == ["source_file", "source_line"]


def test_long_texts_are_told_apart_by_their_words(spark):
    old = [{"notes": f"alpha beta gamma delta number {i} " * 20, "summary": f"one two three four item {i} " * 20} for i in range(6)]
    new = [{"summary_text": f"alpha beta gamma delta number {i} " * 20, "note_lines": f"one two three four item {i} " * 20} for i in range(6)]
    assert run(frame(spark, [("a", "p", 1, old), ("b", "p", 2, new)])) == [("b", "renamed", "notes", "summary_text"), ("b", "renamed", "summary", "note_lines")]


def test_content_that_differs_far_behind_the_start_and_in_many_tokens(spark):
    head = [f"same{k}" for k in range(900)]  # more than 4,096 characters
    tail = lambda w: [f"{w}{k}" for k in range(3000)]
    old = [{"first": head + tail("a"), "second": head + tail("b")}]
    new = [{"second_old": head + tail("a"), "first_old": head + tail("b")}]
    assert run(frame(spark, [("a", "p", 1, old), ("b", "p", 2, new)])) == [("b", "renamed", "first", "second_old"), ("b", "renamed", "second", "first_old")]


def test_unified_keeps_both_names_where_one_producer_holds_both(spark):
    files = [("a", "p", 1, [{"color": "blue"}]), ("b", "p", 2, [{"colour": "blue"}]), ("c", "q", 1, [{"color": "blue", "colour": "red"}]), ("d", "q", 2, [{"colour": "green"}])]
    assert sorted((r["source_file"], r["color"], r["colour"]) for r in drift.unified(frame(spark, files), "span").collect()) == [("a", None, "blue"), ("b", None, "blue"), ("c", "blue", "red"), ("d", None, "green")]


def test_unified_follows_a_producers_own_rename_beside_a_clash(spark):
    words = {"x": "one two", "y": "three four"}
    # q holds both names of p's rename, then renames color itself after colour has gone
    files = [("a", "p", 1, [{"color": words["x"]}]), ("b", "p", 2, [{"colour": words["x"]}]), ("c", "q", 1, [{"color": words["x"], "colour": words["y"]}]), ("d", "q", 2, [{"color": words["x"]}]), ("e", "q", 3, [{"colour": words["x"]}])]
    rows = {r["source_file"]: r.asDict() for r in drift.unified(frame(spark, files), "span").collect()}
    held = {f: {v for k, v in r.items() if v is not None and not k.startswith("source_")} for f, r in rows.items()}
    assert held == {"a": {"one two"}, "b": {"one two"}, "c": {"one two", "three four"}, "d": {"one two"}, "e": {"one two"}}


def test_own_names():
    assert drift.own_names([(3, "x", "z")], {(0, "x"), (1, "z")}) == [("x", 0, 3, "z"), ("z", 3, None, "z")]
    assert drift.own_names([(3, "x", "z")], {(0, "x"), (0, "z"), (1, "z")}) == [("x", 0, 3, "x"), ("z", 0, 3, "z"), ("z", 3, None, "z")]
    assert drift.followed("x", 1, [(2, "x", "y"), (4, "y", "z")]) == "z" and drift.followed("x", 3, [(2, "x", "y")]) == "x"


def test_no_producer_is_one_producer(spark):
    assert run(frame(spark, [("a", None, 1, [{"x": 1}]), ("b", None, 2, [{"y": True}])])) == [("b", "added", "y", ""), ("b", "removed", "x", "")]


def test_files_are_numbered_over_days_and_without_a_date(spark):
    df = frame(spark, [("c", "p", 30, [{"x": 1}]), ("a", "p", 5, [{"x": 1}]), ("b", "p", 5, [{"x": 1}]), ("d", "p", 100, [{"x": 1}]), ("e", "q", 1, [{"x": 1}])])
    none = df.filter("file_name = 'a'").selectExpr("'z' as file_name", "record_kind", "producer", "cast(null as timestamp) as written_at", "line_no", "body", "field", "type")
    got = drift.numbered(drift.lines(df.unionByName(none))).collect()
    assert sorted((r["producer"], r["place"], r["file_name"]) for r in got) == [("p", 1, "z"), ("p", 2, "a"), ("p", 3, "b"), ("p", 4, "c"), ("p", 5, "d"), ("q", 1, "e")]
