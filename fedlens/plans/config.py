"""Run settings with their bounds, and peer topologies as edge tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.operators import messages

MAX_FANOUT, MAX_LAYERS, MAX_WINDOW, MESH_PEERS = 64, 16, 256, 1000


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Topology:
    """kind: full_mesh, ring, gossip (with fanout), hierarchical (with layers) or star."""

    kind: str = "gossip"
    fanout: int = 3
    layers: int = 2

    def __post_init__(self):
        if self.kind not in ("full_mesh", "ring", "gossip", "hierarchical", "star"):
            raise ConfigError("unknown_topology")
        if self.kind == "gossip" and not 1 <= self.fanout <= MAX_FANOUT:
            raise ConfigError("fanout_out_of_range")
        if self.kind == "hierarchical" and not 1 <= self.layers <= MAX_LAYERS:
            raise ConfigError("layers_out_of_range")

    def edges(self, spark: SparkSession, peers: int, seed: int = 0) -> DataFrame:
        """(source, target) over peers 0 to peers - 1; linear in the peers but for full_mesh, which is bounded."""
        ids = spark.range(peers).withColumnRenamed("id", "source")
        if self.kind == "ring":
            out = ids.withColumn("target", (F.col("source") + 1) % F.lit(peers))
        elif self.kind == "star":
            out = ids.filter("source > 0").withColumn("target", F.lit(0).cast("long"))
        elif self.kind == "hierarchical":  # a tree of that many layers, as even as can be
            branch = max(2, math.ceil(peers ** (1 / max(1, self.layers))))
            out = ids.filter("source > 0").withColumn("target", F.floor((F.col("source") - 1) / branch))
        elif self.kind == "gossip":
            partner = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("k")), F.lit(max(1, peers - 1)))
            out = ids.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(self.fanout)))).withColumn("target", partner).withColumn("target", F.when(F.col("target") >= F.col("source"), F.col("target") + 1).otherwise(F.col("target")))
        else:
            if peers > MESH_PEERS:
                raise ConfigError("full_mesh_too_large")
            out = ids.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, peers - 1)).cast("long"))))
        return out.select("source", "target").filter(f"source <> target and target < {peers}").distinct()


@dataclass(frozen=True)
class ReplayConfig:
    capacity: int = 1000
    window: int = 16
    skew_seconds: int = 60

    def __post_init__(self):
        if self.capacity < 1:
            raise ConfigError("capacity_zero")
        if not 0 <= self.window <= MAX_WINDOW:
            raise ConfigError("window_out_of_range")


@dataclass(frozen=True)
class SecurityConfig:
    """What `messages.verified` asks of a message."""

    require_signature: bool = True
    replay: ReplayConfig = field(default_factory=ReplayConfig)

    def verified(self, df: DataFrame) -> DataFrame:
        return messages.verified(df, self.replay.skew_seconds, self.replay.window, self.require_signature)


@dataclass(frozen=True)
class RunConfig:
    topology: Topology = field(default_factory=Topology)
    aggregation: str = "trimmed_mean"
    trim: float = 0.2
    rounds: int = 100
    threshold: float = 0.01

    def __post_init__(self):
        if self.rounds < 1:
            raise ConfigError("rounds_zero")
        if not (math.isfinite(self.threshold) and self.threshold >= 0):
            raise ConfigError("bad_threshold")


def in_time(updates: DataFrame, rounds: DataFrame, sent: Column) -> DataFrame:
    """`updates` with `late`: sent after their round's deadline, or in no round; `rounds` has (round_id, deadline), one row each."""
    joined = updates.join(rounds.select("round_id", F.col("deadline").alias("__deadline")), "round_id", "left")
    return joined.withColumn("late", F.coalesce(sent > F.col("__deadline"), F.lit(True))).drop("__deadline")


def round_status(rounds: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """(round_id, received, status): complete with all expected updates, failed past the deadline, else collecting; pending before any.

    `rounds` has (round_id, expected, deadline).
    """
    got = updates.groupBy("round_id").agg(F.countDistinct("sender").alias("received"))
    both = rounds.join(got, "round_id", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    status = F.when(F.col("received") >= F.col("expected"), "complete").when(now > F.col("deadline"), "failed").when(F.col("received") > 0, "collecting").otherwise("pending")
    return both.select("round_id", "received", status.alias("status"))
