"""Pipeline graphs: typed nodes and edges, their checks, identity and a deterministic order.

A graph has at most thousands of nodes and is planned on the driver; the same checks over graphs kept as
tables, many pipelines at once, are DataFrame queries further down.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedlens.functions import identity

KEY_BYTES, TYPE_BYTES, INPUTS, OUTPUTS, PARAMS = 256, 128, 256, 256, 128
OP_KINDS = ("data", "model", "comms", "system", "control")
TRUSTS = ("core", "sandboxed_extension", "unsafe_extension")


class GraphError(ValueError):
    """code: duplicate_node_key, duplicate_node_id, unknown_endpoint, cycle_detected, node_key_too_long, ..."""

    def __init__(self, code: str, about: Iterable[str] = ()):
        self.code, self.about = code, tuple(about)
        super().__init__(f"{code}: {', '.join(self.about)}" if self.about else code)


@dataclass(frozen=True)
class Node:
    node_key: str
    op_type: str
    op_kind: str = "data"
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict, hash=False)
    code_ref: str | None = None
    execution_trust: str = "core"
    node_id: str | None = None
    node_def_hash: str | None = None
    op_hash: str | None = None

    def checked(self) -> Node:
        """Self, if within bounds; else the first bound it breaks."""
        for bad, code in (
            (not self.node_key, "node_key_empty"),
            (len(self.node_key.encode()) > KEY_BYTES, "node_key_too_long"),
            (len(self.op_type.encode()) > TYPE_BYTES, "op_type_too_long"),
            (len(self.inputs) > INPUTS, "too_many_inputs"),
            (len(self.outputs) > OUTPUTS, "too_many_outputs"),
            (len(self.params) > PARAMS, "too_many_params"),
        ):
            if bad:
                raise GraphError(code, [self.node_key[:80]])
        return self

    def normalised(self, code_ref: str | None = None) -> Node:
        """With id and hashes filled in; ids given before are overwritten."""
        code = self.code_ref or code_ref
        params = json.dumps(self.params, sort_keys=True, separators=(",", ":"))
        digest = lambda *x: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()
        return replace(self, code_ref=code, node_id=hashlib.sha256(self.node_key.encode()).hexdigest()[:32], op_hash=digest("op.v0", self.op_kind, self.op_type, code, params), node_def_hash=digest("node.v1", self.op_kind, self.op_type, code, list(self.inputs), list(self.outputs), params))


@dataclass(frozen=True)
class Edge:
    from_node_id: str
    to_node_id: str
    asset_key: str | None = None


@dataclass(frozen=True)
class Graph:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...] = ()

    def validated(self) -> Graph:
        ids = [n.node_id or n.normalised().node_id for n in self.nodes]
        for values, code in (([n.node_key for n in self.nodes], "duplicate_node_key"), (ids, "duplicate_node_id")):
            twice = sorted({v for v in values if values.count(v) > 1})
            if twice:
                raise GraphError(code, twice)
        for n in self.nodes:
            n.checked()
        unknown = sorted({i for e in self.edges for i in (e.from_node_id, e.to_node_id)} - set(ids))
        if unknown:
            raise GraphError("unknown_endpoint", unknown)
        return self

    def normalised(self, code_ref: str | None = None) -> Graph:
        return replace(self, nodes=tuple(n.normalised(code_ref) for n in self.nodes))

    def implied_edges(self) -> tuple[Edge, ...]:
        """Edges from the node that makes an asset to those that read it, but to itself."""
        maker = {a: n for n in self.nodes for a in n.outputs}
        return tuple(Edge(maker[a].node_id, n.node_id, a) for n in self.nodes for a in n.inputs if a in maker and maker[a] is not n)

    def ordered(self, strict_edges: bool = False) -> list[Node]:
        """A topological order; of the nodes ready at a time the one with the smallest (node_key, id) comes first.

        With `strict_edges` only the graph's own edges order it, else shared assets do too. Repeated edges
        count once; what is left over when a loop blocks, nodes behind it included, is named in the error.
        """
        g = self.validated().normalised()
        g.validated()
        pairs = {(e.from_node_id, e.to_node_id) for e in (*g.edges, *(() if strict_edges else g.implied_edges()))}
        by_id, waits, after = {n.node_id: n for n in g.nodes}, {n.node_id: 0 for n in g.nodes}, {n.node_id: [] for n in g.nodes}
        for a, b in pairs:
            waits[b] += 1
            after[a].append(b)
        ready = [(n.node_key, n.node_id) for n in g.nodes if not waits[n.node_id]]
        heapq.heapify(ready)
        out = []
        while ready:
            _, i = heapq.heappop(ready)
            out.append(by_id[i])
            for b in after[i]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, (by_id[b].node_key, b))
        if len(out) < len(g.nodes):
            raise GraphError("cycle_detected", sorted(n.node_key for n in g.nodes if waits[n.node_id]))
        return out


def policy(permit_all: bool = False) -> Column:
    """Why a node of the nodes table may not run, or null."""
    return F.lit(None).cast("string") if permit_all else F.when(~F.coalesce(F.col("execution_trust") == "core", F.lit(False)), F.concat(F.lit("policy_denied:"), F.coalesce("execution_trust", F.lit("unknown"))))


def node_error() -> Column:
    """The first bound a row of the nodes table breaks, or null."""
    checks = [
        (F.coalesce(F.octet_length("node_key"), F.lit(0)) == 0, "node_key_empty"),
        (F.octet_length("node_key") > KEY_BYTES, "node_key_too_long"),
        (F.octet_length("op_type") > TYPE_BYTES, "op_type_too_long"),
        (F.size("inputs") > INPUTS, "too_many_inputs"),
        (F.size("outputs") > OUTPUTS, "too_many_outputs"),
        (F.json_object_keys("params").isNotNull() & (F.size(F.json_object_keys("params")) > PARAMS), "too_many_params"),
    ]
    return F.coalesce(*[F.when(bad, code) for bad, code in checks])


def node_inputs(nodes: DataFrame) -> DataFrame:
    """(node_no, pos, asset_key) of every input that isn't blank, in normal form."""
    from fedlens.common import asset_form

    return nodes.select("node_no", F.posexplode("inputs").alias("pos", "raw")).select("node_no", "pos", asset_form(F.col("raw")).alias("asset_key")).filter("asset_key is not null")


def unsafe_nodes(nodes: DataFrame, trust: DataFrame) -> DataFrame:
    """(node_no, unsafe): not core, or an input that is untrusted or unknown; `trust` has (asset_key, trust), one row per key."""
    bad = node_inputs(nodes).join(trust, "asset_key", "left").groupBy("node_no").agg(F.max(F.coalesce(F.col("trust") != "trusted", F.lit(True))).alias("bad"))
    return nodes.select("node_no", "execution_trust").distinct().join(bad, "node_no", "left").select("node_no", (F.coalesce(F.col("execution_trust") != "core", F.lit(True)) | F.coalesce("bad", F.lit(False))).alias("unsafe"))


def trust_rollup(nodes: DataFrame, trust: DataFrame) -> DataFrame:
    """(node_no, unsafe) as `unsafe_nodes`, and of every node that reads, over any number of steps, what such a node makes.

    Each round takes the nodes first reached in the last one a step further and is written to the shared folder.
    """
    from fedlens.common import asset_form, staged

    made = nodes.select("node_no", F.explode("outputs").alias("raw")).select(F.col("node_no").alias("maker"), asset_form(F.col("raw")).alias("asset_key")).dropna().distinct()
    steps = staged(made.join(node_inputs(nodes).select("node_no", "asset_key").distinct(), "asset_key").select("maker", "node_no").filter("maker <> node_no").distinct(), "trust-steps")
    judged = staged(unsafe_nodes(nodes, trust).groupBy("node_no").agg(F.max("unsafe").alias("unsafe")), "trust-0")
    bad = fresh = judged.filter("unsafe").select("node_no")
    for step in itertools.count(1):  # ends when a round reaches no further node
        ahead = steps.join(fresh.withColumnRenamed("node_no", "maker"), "maker").select("node_no").distinct()
        fresh = staged(ahead.join(bad, "node_no", "left_anti"), f"trust-{step}")
        if fresh.isEmpty():
            break
        bad = bad.unionByName(fresh)
        if step % 16 == 0:
            bad = staged(bad, f"trust-to-{step}")
    return judged.select("node_no").join(bad.distinct().withColumn("__bad", F.lit(True)), "node_no", "left").select("node_no", F.coalesce("__bad", F.lit(False)).alias("unsafe"))


def missing_inputs(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(node_no, asset_key): the first input of a node that no registry entry has."""
    gone = node_inputs(nodes).join(registry.select("asset_key"), "asset_key", "left_anti")
    return gone.groupBy("node_no").agg(F.min_by("asset_key", "pos").alias("asset_key"))


def unknown_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_no, side, node_id): the ends of edges that no node has, in normal form; an end that is null or blank has no id."""
    from fedlens.common import plain

    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), plain(F.col(f"{side}_node_id")).alias("node_id")) for side in ("from", "to")]))
    each = edges.select("edge_no", ends.alias("e")).select("edge_no", "e.side", "e.node_id").distinct()
    return each.join(nodes.select(plain(F.col("node_id")).alias("node_id")).dropna().distinct(), "node_id", "left_anti").select("edge_no", "side", "node_id")


def in_degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree) over distinct edges."""
    from fedlens.common import plain

    ends = edges.select(plain(F.col("from_node_id")).alias("a"), plain(F.col("to_node_id")).alias("node_id")).dropna().distinct()
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def contract(declared: DataFrame, given: DataFrame, by: str) -> DataFrame:
    """(by, asset_key, problem): outputs declared and missing, given and undeclared, or given twice. Both have (by, asset_key)."""
    d = declared.select(by, "asset_key").distinct().withColumn("declared", F.lit(True))
    g = given.groupBy(by, "asset_key").agg(F.count(F.lit(1)).alias("times"))
    both = d.join(g, [by, "asset_key"], "full")
    return both.select(by, "asset_key", F.when(F.col("times").isNull(), "missing_output").when(F.col("declared").isNull(), "undeclared_output").when(F.col("times") > 1, "duplicate_output").alias("problem")).filter("problem is not null")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, level): the longest way from a node without edges into it; nodes on or behind a loop are absent.

    One step of all graphs at once per round, each written to the shared folder; rounds end with the deepest graph.
    """
    from fedlens.common import staged

    links = edges.select("from_node_id", "to_node_id").distinct()
    waits = links.groupBy("to_node_id").agg(F.count(F.lit(1)).alias("need"))
    done = staged(nodes.select("node_id").distinct().join(waits, nodes.node_id == waits.to_node_id, "left_anti").select("node_id", F.lit(0).alias("level")), "levels-0")
    for step in itertools.count(1):  # ends with the deepest graph: each round has other nodes
        seen = links.join(done, links.from_node_id == done.node_id).groupBy("to_node_id").agg(F.count(F.lit(1)).alias("have"))
        ready = seen.join(waits, "to_node_id").filter("have = need").select(F.col("to_node_id").alias("node_id")).join(done, "node_id", "left_anti").withColumn("level", F.lit(step))
        ready = staged(ready, f"levels-{step}")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        if step % 16 == 0:
            done = staged(done, f"levels-to-{step}")
    return done


def definition(nodes: DataFrame) -> DataFrame:
    """(node_no, node_id, op_hash, node_def_hash) of the nodes table."""
    args = (F.col("op_kind"), F.col("op_type"), F.col("code_ref"))
    return nodes.select("node_no", identity.node_id(F.col("node_key")).alias("node_id"), identity.op_hash(*args, F.col("params")).alias("op_hash"), identity.node_def_hash(*args, F.col("inputs"), F.col("outputs"), F.col("params")).alias("node_def_hash"))
