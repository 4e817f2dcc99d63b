"""A run as a report: loaded and verified, rendered as HTML and JSON. `python -m fedlens.plans.report RUN_DIR [OUT.html] [--json-out FILE]`"""

from __future__ import annotations

import io
import json
import sys
from dataclasses import dataclass
from html import escape
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.functions.identity import descriptor_error
from fedlens.operators import records
from fedlens.plans.graph import TRUSTS  # noqa: F401  the domains shown in the report
from fedlens.sources.store import Bundle, StoreError


@dataclass
class Run:
    run_id: str
    graph: dict
    registry: DataFrame
    lineage: DataFrame
    materializations: DataFrame
    spans: DataFrame
    events: DataFrame
    metrics: DataFrame
    warnings: list[str]

    def timeline(self) -> DataFrame:
        return records.timeline(self.spans, self.events, self.metrics, self.materializations).orderBy("ts", "kind", "name", "detail")

    def untrusted(self) -> DataFrame:
        return self.registry.filter("trust = 'untrusted'")

    def unsafe(self) -> DataFrame:
        return self.materializations.filter("unsafe_surface")

    def unsafe_nodes(self) -> list[str]:
        """Keys of nodes that aren't core or read an asset that is untrusted or unknown."""
        trust = {r["asset_key"]: r["trust"] for r in self.registry.select("asset_key", "trust").collect()}
        return sorted(n["node_key"] for n in self.graph.get("nodes", []) if n.get("execution_trust", "core") != "core" or any(trust.get(k) != "trusted" for k in n.get("inputs", [])))


def load(spark: SparkSession, run_dir: str) -> Run:
    """Verify the manifest first: any problem stops. Descriptors out of bounds and mismatched snapshots are warnings."""
    b = Bundle.open(spark, run_dir)
    problems = b.problems()
    if problems:
        raise StoreError(f"manifest: {problems[0][1]} {problems[0][0]}")
    warnings = [w for w in [b.snapshot_warning()] if w]
    registry = b.registry()
    long = registry.select("asset_key", descriptor_error(F.col("source.uri"), F.col("source.etag_or_version")).alias("e")).filter("e is not null")
    warnings += [f"{r['asset_key']}: {r['e']}" for r in long.collect()]
    return Run(b.read("run.json")["run_id"], b.read("graph.json"), registry, b.lineage(), b.materializations(), b.log("spans.ndjson"), b.log("events.ndjson"), b.log("metrics.ndjson"), warnings)


SHOWN = 10_000  # rows of a table that a page shows; the JSON has them all


def _table(title: str, df: DataFrame, columns: list[str], most: int = SHOWN) -> str:
    rows = df.select(*[F.col(c).cast("string") for c in columns]).limit(most + 1).collect()
    note = f"<p>The first {most} of {df.count()} rows.</p>" if len(rows) > most else ""
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('?' if v is None else v)}</td>" for v in r) + "</tr>" for r in rows[:most])
    return f"<h2>{escape(title)}</h2>{note}<table><tr>{head}</tr>{body}</table>"


def svg(graph: dict) -> str:
    """Nodes in a row and their edges; edges to unknown nodes are left out."""
    at = {n.get("node_id") or n["node_key"]: i for i, n in enumerate(graph.get("nodes", []))}
    boxes = "".join(f'<rect x="{20 + 180 * i}" y="20" width="150" height="40"/><text x="{26 + 180 * i}" y="45">{escape(n["node_key"][:24])}</text>' for i, n in enumerate(graph.get("nodes", [])))
    lines = "".join(f'<line x1="{170 + 180 * at[e["from_node_id"]]}" y1="40" x2="{20 + 180 * at[e["to_node_id"]]}" y2="40"/>' for e in graph.get("edges", []) if e["from_node_id"] in at and e["to_node_id"] in at)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{max(200, 180 * len(at) + 40)}" height="80" fill="none" stroke="black">{boxes}{lines}</svg>'


def html(run: Run) -> str:
    nodes = "".join(f"<li>{escape(k)}</li>" for k in run.unsafe_nodes()) or "<li>none</li>"
    warnings = "".join(f"<li>{escape(w)}</li>" for w in run.warnings)
    return (
        f"<!doctype html><meta charset='utf-8'><title>Run {escape(run.run_id)}</title><h1>Run {escape(run.run_id)}</h1><ul>{warnings}</ul>{svg(run.graph)}<h2>Unsafe nodes</h2><ul>{nodes}</ul>"
        + _table("Untrusted datasets", run.untrusted(), ["asset_key", "fingerprint_v0"])
        + _table("Unsafe materialisations", run.unsafe(), ["asset_key", "op_type", "unsafe_reasons", "status"])
        + _table("Timeline", run.timeline(), ["ts", "kind", "name", "detail"])
        + _table("Registry", run.registry, ["asset_key", "trust", "fingerprint_v0"])
        + _table("Lineage", run.lineage.orderBy("output_fingerprint_v0", "input_fingerprint_v0"), ["input_fingerprint_v0", "output_fingerprint_v0", "node_id", "op_kind"])
    )


SECTIONS = ("registry", "lineage", "materializations", "spans", "events", "metrics")


def write_json(run: Run, out: TextIO) -> None:
    """The whole run as one JSON object; its records pass through a part at a time."""
    out.write(json.dumps({"run_id": run.run_id, "graph": run.graph, "warnings": run.warnings})[:-1])
    for name in SECTIONS:
        df = getattr(run, name)
        out.write(f', "{name}": [')
        for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()):
            out.write((", " if i else "") + r[0])
        out.write("]")
    out.write("}")


def as_json(run: Run) -> dict:
    """The same as a value, for runs that fit the driver."""
    out = io.StringIO()
    write_json(run, out)
    return json.loads(out.getvalue())


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    out = next((a for a in args[1:] if not a.startswith("--") and args[args.index(a) - 1] != "--json-out"), "report.html")
    spark = SparkSession.builder.getOrCreate()
    run = load(spark, args[0])
    with open(out, "w") as f:
        f.write(html(run))
    if "--json-out" in args:
        with open(args[args.index("--json-out") + 1], "w") as f:
            write_json(run, f)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
