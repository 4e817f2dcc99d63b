"""Schemas that drift between files: what changed where, and one consistent table.

Method. Every file's schema is read in parallel from its own lines: one pass parses each line and aggregates
per (file, field) the types seen and what the content looks like. Types are folded through a promotion
lattice (null < boolean, integer < number, everything < string). Neighbouring files of a producer are then
compared field by field; a field that goes and one that comes in the same file with the same type and like
content are one renamed field. The union schema of a kind, its fields named across renames, is the only
thing the driver holds; all files are cast to it in one further pass.

Content is compared by tokens of the whole value: the words of texts, arrays and objects, the magnitude of
numbers, and for values that are never alike (hex, digits, addresses) their form and length. Two fields are
alike as far as the shares of their tokens overlap, over all their tokens; names decide only between
candidates that are equally alike.

Scale: lines are aggregated in the map tasks, so what is shuffled is per (file, field, token) whatever the
files' length; only tokens of fields that go or come are compared, by a join on the token. A long token
travels as its hash. A producer with a third of all rows spreads over all tasks.

Defined results: lines that are null, empty, broken, not an object or with a name twice are not valid and
count nowhere; a field is in a file if a valid line holds it with a value other than null; a file without
valid lines has no fields; a file's written_at is its smallest; files of one instant go by name; a line may
repeat and other columns may have any name; no producer or kind is one of its own, named by the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedlens.common import staged

ALIKE, LONG = 0.3, 40
FILE = ["producer", "kind", "file_name"]


def lines(raw: DataFrame, body: str = "body", file: str = "file_name", producer: str = "producer", kind: str = "record_kind", written: str = "written_at", line: str = "line_no") -> DataFrame:
    """(producer, kind, file_name, written_at, line_no, record): the valid lines have a record, the others null."""
    c = lambda n: raw[f"`{n}`"]
    parsed = F.try_parse_json(c(body))
    return raw.select(F.coalesce(c(producer), F.lit("")).alias("producer"), F.coalesce(c(kind), F.lit("")).alias("kind"), c(file).alias("file_name"), c(written).alias("written_at"), c(line).alias("line_no"), F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).alias("record")).filter("file_name is not null")


def values(valid: DataFrame) -> DataFrame:
    """(producer, kind, file_name, field, type, text) of every value that isn't null."""
    spark = valid.sparkSession
    each = spark.sql("SELECT producer, kind, file_name, e.key AS field, schema_of_variant(e.value) AS described, cast(e.value AS string) AS text, to_json(e.value) AS json FROM {valid}, LATERAL variant_explode(record) AS e WHERE record IS NOT NULL", valid=valid)
    d = F.col("described")
    kind = (
        F.when(d.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | d.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .when(d.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(d == "BOOLEAN", "boolean")
        .when(d.startswith("ARRAY"), "array")
        .when(d.startswith("OBJECT"), "object")
        .when(d == "STRING", "string")
    )
    return each.select("producer", "kind", "file_name", "field", kind.alias("type"), F.when(kind.isin("array", "object"), F.col("json")).otherwise(F.col("text")).alias("text")).filter("type is not null")


def folded(types: str) -> str:
    """SQL for the least type above an array of types in the promotion lattice."""
    return f"CASE WHEN size({types}) = 1 THEN {types}[0] WHEN size({types}) = 2 AND array_contains({types}, 'integer') AND array_contains({types}, 'number') THEN 'number' WHEN size({types}) = 0 THEN NULL ELSE 'string' END"


def fields(summary: DataFrame) -> DataFrame:
    """(producer, kind, file_name, field, type): the header schema of every file."""
    types = summary.groupBy(*FILE, "field").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return types.select(*FILE, "field", F.expr(folded("types")).alias("type"))


def numbered(valid: DataFrame) -> DataFrame:
    """(producer, kind, file_name, written_at, place): the files of each producer in the order they were written, ordered within days and days within a producer."""
    each = valid.groupBy(*FILE).agg(F.min("written_at").alias("written_at")).withColumn("day", F.coalesce(F.unix_date(F.col("written_at").cast("date")), F.lit(-(2**31))))
    before = Window.partitionBy("producer", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = each.groupBy("producer", "kind", "day").agg(F.count(F.lit(1)).alias("n")).select("producer", "kind", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("producer", "kind", "day").orderBy("written_at", "file_name")
    placed = each.withColumn("nth", F.row_number().over(inside)).join(days, ["producer", "kind", "day"])
    return placed.select(*FILE, "written_at", (F.col("start") + F.col("nth")).cast("int").alias("place"))


def words_of(text: Column, pattern: str) -> Column:
    """All parts of a text that match, digits as 9, those longer than `LONG` as their hash."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda w: F.when(F.length(w) > LONG, F.concat(F.lit("# "), F.xxhash64(w).cast("string"))).otherwise(w))


def summarised(valid: DataFrame) -> DataFrame:
    """(producer, kind, file_name, field, type, word, n), from one pass over the lines and written to the shared folder.

    `word` is null for a value without tokens, such as an empty array.
    """
    text = F.col("text")
    size = F.floor(F.log10(F.abs(text.try_cast("double")) + 1))
    form = (
        F.when(F.col("type").isin("integer", "number"), F.array(F.concat(F.lit("size "), size.cast("string"))))
        .when(F.col("type") == "boolean", F.array(F.lit("boolean")))
        .when(F.col("type").isin("array", "object"), words_of(text, "[A-Za-z_][A-Za-z_0-9]*|-?[0-9]+"))
        .when(text.rlike("^-?[0-9.]+$"), F.array(F.concat(F.lit("digits "), F.length(text).cast("string"))))
        .when(text.rlike("^[0-9a-fA-F]{8,}$"), F.array(F.concat(F.lit("hex "), F.length(text).cast("string"))))
        .when(text.contains("://"), F.array(F.concat(F.lit("address "), F.split(text, "://")[0])))
        .when(text.rlike("^\\s*$"), F.array(F.lit("blank")))
        .otherwise(words_of(F.regexp_replace(text, "[0-9]+", "9"), "\\S+"))
    )
    counted = values(valid).select(*FILE, "field", "type", F.explode_outer(form).alias("word")).groupBy(*FILE, "field", "type", "word").agg(F.count(F.lit(1)).alias("n"))
    return staged(counted, "drift-fields")


def token_shares(summary: DataFrame) -> DataFrame:
    """(producer, kind, file_name, field, word, share): the part of a field's tokens that are this one."""
    counted = summary.filter("word is not null").groupBy(*FILE, "field", "word").agg(F.sum("n").alias("n"))
    every = counted.groupBy(*FILE, "field").agg(F.sum("n").alias("all"))
    return counted.join(every, [*FILE, "field"]).select(*FILE, "field", "word", (F.col("n") / F.col("all")).alias("share"))


def name_likeness(a: str, b: str) -> float:
    short = lambda s: s.replace("_", "").lower()
    return SequenceMatcher(None, short(a), short(b)).ratio()


def matched(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """One to one: of (gone, come, alike) the most alike pair first, then the next among those left."""
    named = [(-round(alike * 4), -name_likeness(gone, come), -alike, gone, come) for gone, come, alike in pairs]
    gone_taken, come_taken, keep = set(), set(), []
    for *_, gone, come in sorted(named):
        if gone not in gone_taken and come not in come_taken:
            keep.append((gone, come))
            gone_taken.add(gone)
            come_taken.add(come)
    return keep


def renames(likely: DataFrame) -> DataFrame:
    """(producer, kind, file_name, gone, come) chosen from candidates (producer, kind, file_name, gone, come, alike)."""
    names = [*FILE, "gone", "come"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, float]] = []
        file, out = None, []
        for b in batches:
            for *key, gone, come, alike in zip(*[b.column(c).to_pylist() for c in (*names, "alike")], strict=True):
                if key != file:
                    out += [(*file, *pair) for pair in matched(held)] if held else []
                    file, held = key, []
                held.append((gone, come, alike))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*[(*file, *pair) for pair in matched(held)], strict=True)], names)

    tasks = max(1, likely.sparkSession.sparkContext.defaultParallelism)
    return likely.repartition(tasks, *FILE).sortWithinPartitions(*FILE).mapInArrow(run, ", ".join(f"{c} string" for c in names))


def changes(raw: DataFrame, **columns: str) -> DataFrame:
    """(producer, kind, file_name, place, change_kind, field_name, new_name), a row per change at the file where it shows."""
    valid = lines(raw, **columns)
    return changed(summarised(valid), staged(numbered(valid), "drift-files"))


def changed(summary: DataFrame, files: DataFrame) -> DataFrame:
    """The same from `summarised` and `numbered`."""
    here = fields(summary).join(files, FILE)
    after = here.select("producer", "kind", (F.col("place") + 1).alias("place"), "field", F.col("type").alias("before"))
    both = here.select("producer", "kind", "place", "field", "type").join(after, ["producer", "kind", "place", "field"], "full")
    differ = both.filter("type is null or before is null or type <> before").join(files.filter("place > 1").select(*FILE, "place"), ["producer", "kind", "place"])
    differ = staged(differ, "drift-differences")
    retyped = differ.filter("type is not null and before is not null").select(*FILE, "place", F.lit("retyped").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("new_name"))
    gone = differ.filter("type is null").select(*FILE, "place", F.col("field").alias("gone"), F.col("before").alias("type"))
    come = differ.filter("before is null").select(*FILE, "place", F.col("field").alias("come"), "type")
    # like content: that of the field's last file against that of the new field's first
    shares = token_shares(summary)
    before = files.select("producer", "kind", (F.col("place") + 1).alias("place"), F.col("file_name").alias("earlier"))
    old = gone.join(before, ["producer", "kind", "place"]).join(shares.select("producer", "kind", F.col("file_name").alias("earlier"), F.col("field").alias("gone"), "word", F.col("share").alias("old")), ["producer", "kind", "earlier", "gone"])
    new = come.join(shares.select(*FILE, F.col("field").alias("come"), "word", F.col("share").alias("new")), [*FILE, "come"])
    alike = old.select(*FILE, "type", "word", "gone", "old").join(new.select(*FILE, "type", "word", "come", "new"), [*FILE, "type", "word"]).groupBy(*FILE, "gone", "come").agg(F.sum(F.least("old", "new")).alias("alike"))
    renamed = staged(renames(alike.filter(F.col("alike") >= ALIKE)), "drift-renames")
    gone = gone.join(renamed, [*FILE, "gone"], "left")
    come = come.join(renamed.select(*FILE, "come", F.lit(True).alias("known")), [*FILE, "come"], "left").filter("known is null")
    lost = gone.select(*FILE, "place", F.when(F.col("come").isNull(), "removed").otherwise("renamed").alias("change_kind"), F.col("gone").alias("field_name"), F.coalesce("come", F.lit("")).alias("new_name"))
    added = come.select(*FILE, "place", F.lit("added").alias("change_kind"), F.col("come").alias("field_name"), F.lit("").alias("new_name"))
    return retyped.unionByName(lost).unionByName(added)


@dataclass(frozen=True)
class Source:
    """Where a column's values come from: a field of any producer but `without`, or of one producer's files from the place `lo` on to before `hi`."""

    name: str
    producer: str | None = None
    lo: int = 0
    hi: int | None = None
    without: tuple[str, ...] = ()


def _groups(own: dict, links: list[tuple[str, str]]) -> list[list[str]]:
    """Names linked by renames, those of most files first."""
    root = {f: f for f in own}

    def find(f: str) -> str:
        while root[f] != f:
            f = root[f]
        return f

    for a, b in sorted(links):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out: dict[str, list[str]] = {}
    for f in sorted(own):
        out.setdefault(find(f), []).append(f)
    return [sorted(names, key=lambda f: (-own[f]["files"], f)) for names in out.values()]


def followed(name: str, since: int, steps: list[tuple[int, str, str]]) -> str:
    """What a field of the files before the place `since` is called after the later renames (place, gone, come)."""
    for place, gone, come in steps:
        if place >= since and gone == name:
            name = come
    return name


def own_names(steps: list[tuple[int, str, str]], held: set[tuple[int, str]]) -> list[tuple[str, int, int | None, str]]:
    """(name, from, to, column) for a producer that holds several linked names at once, by ranges of its files between renames.

    `held` has (number of renames up to a file, name). A name is carried along its renames unless another field of the
    same range has that name itself; then both keep their own.
    """
    cuts = [0, *sorted({place for place, *_ in steps})]
    out = []
    for k, lo in enumerate(cuts):
        hi = cuts[k + 1] if k + 1 < len(cuts) else None
        here = sorted(name for n, name in held if n == k)
        column = {name: followed(name, lo + 1, steps) for name in here}
        for name in here:
            if sum(c == column[name] for c in column.values()) > 1:
                column[name] = name
        out += [(name, lo, hi, column[name]) for name in here]
    return out


def union_schema(summary: DataFrame, changes_found: DataFrame, files: DataFrame) -> dict[str, list[tuple[str, str, list[Source]]]]:
    """Per kind, (column, type, where its values come from).

    Fields linked by renames are one column, named as most files name it. A producer one of whose files holds
    several linked names at once has them apart: there a name is only followed along the producer's own renames,
    within the range of files each of them covers, so no value is lost. The driver receives a row per field
    name and type of a kind, per distinct rename, and per rename of such a producer; not per file.
    """
    spark = summary.sparkSession
    seen = summary.groupBy("kind", "field").agg(F.sort_array(F.collect_set("type")).alias("types"), F.approx_count_distinct("file_name").alias("files")).collect()
    moved = changes_found.filter("change_kind = 'renamed'")
    links = moved.select("kind", "field_name", "new_name").distinct().collect()
    groups = {}
    for kind in sorted({r["kind"] for r in seen if r["kind"] is not None}):
        groups[kind] = _groups({r["field"]: r for r in seen if r["kind"] == kind}, [(r["field_name"], r["new_name"]) for r in links if r["kind"] == kind])
    linked = [(kind, f, names[0]) for kind, every in groups.items() for names in every if len(names) > 1 for f in names]
    apart: dict[tuple[str, str], dict[str, tuple[list, set]]] = {}
    if linked:
        named = summary.select(*FILE, "field").distinct().join(spark.createDataFrame(linked, "kind string, field string, head string"), ["kind", "field"])
        both = named.groupBy(*FILE, "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("producer", "kind", "head").distinct()
        heads = {(kind, f): head for kind, f, head in linked}
        steps = both.join(moved.select("producer", "kind", "place", "field_name", "new_name"), ["producer", "kind"]).collect()
        for r in both.collect():
            apart.setdefault((r["kind"], r["head"]), {})[r["producer"]] = ([], set())
        for r in sorted(steps, key=lambda r: r["place"]):
            if heads.get((r["kind"], r["field_name"])) == r["head"]:
                apart[r["kind"], r["head"]][r["producer"]][0].append((r["place"], r["field_name"], r["new_name"]))
        if apart:
            places = [(p, kind, head, sorted({x[0] for x in found[0]})) for (kind, head), by in apart.items() for p, found in by.items()]
            cut = spark.createDataFrame(places, "producer string, kind string, head string, places array<int>")
            held = named.join(cut, ["producer", "kind", "head"]).join(files.select(*FILE, "place"), FILE)
            held = held.select("producer", "kind", "head", "field", F.size(F.filter("places", lambda p: p <= F.col("place"))).alias("n")).distinct()
            for r in held.collect():
                apart[r["kind"], r["head"]][r["producer"]][1].add((r["n"], r["field"]))
    out = {}
    for kind, every in groups.items():
        types = {r["field"]: set(r["types"]) for r in seen if r["kind"] == kind}
        columns: dict[str, list[Source]] = {}
        for names in every:
            special = sorted(apart.get((kind, names[0]), {}).items())
            columns.setdefault(names[0], []).extend(Source(n, without=tuple(p for p, _ in special)) for n in names)
            for producer, (steps_of, held_by) in special:
                for name, lo, hi, column in own_names(steps_of, held_by):
                    columns.setdefault(column, []).append(Source(name, producer, lo, hi))
        out[kind] = []
        for column, sources in sorted(columns.items()):
            have = set().union(*[types[s.name] for s in sources])
            out[kind].append((column, next(iter(have)) if len(have) == 1 else "number" if have == {"integer", "number"} else "string", sources))
    return out


def unified(raw: DataFrame, kind: str, **columns: str) -> DataFrame:
    """Every valid line of one kind as a row of the kind's union schema, with source_file and source_line; arrays and objects as JSON text."""
    valid = lines(raw, **columns).filter(F.col("kind") == kind)
    summary, files = summarised(valid), staged(numbered(valid), "drift-files")
    schema = union_schema(summary, changed(summary, files), files).get(kind, [])
    rows = valid.filter("record is not null")
    special = sorted({s.producer for _, _, sources in schema for s in sources if s.producer is not None})
    if special:  # only these producers' lines need the place of their file
        theirs = F.col("producer").isin(special)
        placed = rows.filter(theirs).join(files.select(*FILE, "place"), FILE).select(*rows.columns, "place")
        rows = rows.filter(~theirs).withColumn("place", F.lit(0)).unionByName(placed)
    target = {"integer": "bigint", "number": "double", "boolean": "boolean"}

    def value(sources: list[Source]) -> Column:
        got = []
        for s in sources:
            held = F.try_variant_get("record", "$['" + s.name.replace("'", "\\'") + "']", "string")
            if s.producer is not None:
                inside = (F.col("producer") == s.producer) & (F.col("place") >= s.lo)
                held = F.when(inside if s.hi is None else inside & (F.col("place") < s.hi), held)
            elif s.without:
                held = F.when(~F.col("producer").isin(*s.without), held)
            got.append(held)
        return F.coalesce(*got)

    wanted = [value(sources).try_cast(target.get(kind_of, "string")).alias("field_" + name if name in ("source_file", "source_line") else name) for name, kind_of, sources in schema]
    return rows.select(F.col("file_name").alias("source_file"), F.col("line_no").alias("source_line"), *wanted)
