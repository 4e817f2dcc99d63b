"""Checks on a stream of signed messages: version, clock, sender, signature, and sequence window.

A check gives a reason instead of dropping the row; the order of checks is the order of cost, and only rows
that pass all of them touch a sender's sequence state. The sequence check is exact in batch: with `prev` the
largest earlier number of the sender, a number is too old if it is at most prev - window, a replay if it was
seen before, and accepted otherwise. A repeated number 0 is a replay; with window 0 a repeat is too old.

Scale: state runs along a sender's arrivals. `sequence_verdict` cuts a sender's arrivals into pieces of
`PIECE` so that one busy sender isn't one task: running maxima come from maxima per piece, and repeats from
a window keyed by (sender, number).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKEW_SECONDS, WINDOW, MAX_WINDOW, PIECE = 60, 16, 256, 100_000
VERSION = (0, 1)
STALE_ROUNDS = 5
QUORUM = 0.67
QUEUE = 1024  # messages a peer's queue holds
#: Codes of the message types (fixed values of the wire format).
MESSAGE_TYPES = {1: "gradient_update", 2: "model_checkpoint", 3: "consensus_vote", 4: "heartbeat", 5: "peer_discovery", 6: "topology_change", 7: "aggregation_result", 8: "round_start", 9: "round_complete", 255: "error"}


def clock_ok(ts: Column, now: Column, skew: int = SKEW_SECONDS) -> Column:
    return F.coalesce(F.abs(now - ts) <= skew, F.lit(False))


def reject_reason(df: DataFrame, skew: int = SKEW_SECONDS, signed: bool = True) -> Column:
    """Why a message is refused before its sequence is looked at, or null. Columns as in the messages table."""
    from fedlens.common import sender_form

    key = sender_form(F.col("sender"))
    return (
        F.when(~((F.col("version_major") == VERSION[0]) & (F.col("version_minor") == VERSION[1])) | F.col("version_major").isNull() | F.col("version_minor").isNull(), "unsupported_version")
        .when(~clock_ok(F.col("ts"), F.col("now"), skew), "expired")
        .when(key.isNull() | ~key.rlike("^[0-9a-f]{64}$") | key.rlike("^0*$"), "invalid_sender")
        .when(F.col("sig_valid").isNull() & F.lit(signed), "missing_signature")
        .when(~F.col("sig_valid") & F.lit(signed), "invalid_signature")
    )


def sequence_verdict(df: DataFrame, peer: Column, sequence: Column, order: Column, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """`df` with `sequence_verdict`: ok, replay or too_old. Rows without peer or number get null."""
    if not 0 <= window <= MAX_WINDOW:
        raise ValueError("window out of range")
    rows = df.withColumns({"__peer": peer, "__seq": sequence.cast("long"), "__at": order.cast("long")})
    bare = rows.filter("__peer is null or __seq is null or __at is null")
    rows = rows.filter("__peer is not null and __seq is not null and __at is not null").withColumn("__piece", F.floor(F.col("__at") / piece))
    along = Window.partitionBy("__peer", "__piece").orderBy("__at")
    heads = rows.groupBy("__peer", "__piece").agg(F.max("__seq").alias("__top"))
    before = Window.partitionBy("__peer").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("__peer", "__piece", F.max("__top").over(before).alias("__carried"))
    inside = rows.withColumn("__inside", F.max("__seq").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    prev = F.greatest("__inside", "__carried")
    firsts = rows.groupBy("__peer", "__seq").agg(F.min("__at").alias("__first"))
    joined = inside.join(carried, ["__peer", "__piece"], "left").join(firsts, ["__peer", "__seq"], "left")
    verdict = F.when(prev.isNull(), "ok").when(F.col("__seq") <= prev - window, "too_old").when(F.col("__first") < F.col("__at"), "replay").otherwise("ok")
    return joined.select(*[joined[c] for c in df.columns], verdict.alias("sequence_verdict")).unionByName(bare.select(*df.columns, F.lit(None).cast("string").alias("sequence_verdict")))


def verified(df: DataFrame, skew: int = SKEW_SECONDS, window: int = WINDOW, signed: bool = True) -> DataFrame:
    """`df` with `verdict`: ok or the first reason to refuse, the sequence check last and on the rest only."""
    from fedlens.common import sender_form

    checked = df.withColumn("verdict", reject_reason(df, skew, signed))
    passed = sequence_verdict(checked.filter("verdict is null").drop("verdict"), sender_form(F.col("sender")), F.col("sequence"), F.col("arrival"), window).withColumnRenamed("sequence_verdict", "verdict")
    return checked.filter("verdict is not null").unionByName(passed)


def every_nth(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The rows at which a cadence of n fires; n = 0 counts as 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") % max(n, 1) == 0)


def staleness_weight(age: Column, decay: str = "exponential", tau: float = 2.0, most: int = STALE_ROUNDS) -> Column:
    """Weight of an update `age` rounds old: 0 beyond `most`, else by the decay none, linear, exponential or threshold."""
    weight = {"none": F.lit(1.0), "linear": 1 - age / F.lit(float(most + 1)), "exponential": F.exp(-age / F.lit(tau)), "threshold": F.when(age == 0, 1.0).otherwise(0.5)}[decay]
    return F.when((age < 0) | (age > most), 0.0).otherwise(weight)


def quorum(votes: DataFrame, round_col: str, accept: Column, ratio: float = QUORUM, weight: Column | None = None) -> DataFrame:
    """(round, votes, accepted, reached), or with `weight` (round, votes, weight, accepted, reached) where accepted adds up weights."""
    each = F.lit(1) if weight is None else weight
    sums = votes.groupBy(F.col(round_col).alias("round")).agg(F.count(F.lit(1)).alias("votes"), F.sum(each).alias("weight"), F.coalesce(F.sum(F.when(accept, each)), F.lit(0)).alias("accepted"))
    out = sums.withColumn("reached", F.coalesce(F.try_divide("accepted", "weight") >= ratio, F.lit(False)))
    return out.drop("weight") if weight is None else out


def mailbox(df: DataFrame, peer: Column, position: Column, limit: int = QUEUE) -> DataFrame:
    """(peer, position, queued): messages in order of position, those behind the first `limit` of a peer refused.

    Only counts per piece of `PIECE` positions are ordered per peer, so a busy peer is not one task's work.
    """
    rows = df.select(peer.alias("peer"), position.cast("long").alias("position")).dropna().withColumn("piece", F.floor(F.col("position") / PIECE))
    before = Window.partitionBy("peer").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("peer", "piece").agg(F.count(F.lit(1)).alias("n")).select("peer", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("peer", "piece").orderBy("position")
    return rows.withColumn("place", F.row_number().over(inside)).join(heads, ["peer", "piece"]).select("peer", "position", (F.col("start") + F.col("place") <= limit).alias("queued"))


def gossip(links: DataFrame, start: int) -> DataFrame:
    """(peer, hops) of the peers a message reaches over links (source, target), by the round it comes in; each round is written to the shared folder."""
    from fedlens.common import staged

    edges = links.select("source", "target").dropna().distinct()
    known = fresh = edges.sparkSession.range(start, start + 1).select(F.col("id").alias("peer"), F.lit(0).alias("hops"))
    for hops in itertools.count(1):  # ends when a round reaches nobody new
        ahead = edges.join(fresh, edges.source == fresh.peer).select(F.col("target").alias("peer")).distinct()
        fresh = staged(ahead.join(known, "peer", "left_anti").withColumn("hops", F.lit(hops)), f"gossip-{hops}")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if hops % 16 == 0:
            known = staged(known, f"gossip-to-{hops}")


LAST_SECOND = 4_102_444_800  # 2100


def clock_error(seconds: Column, last: int = LAST_SECOND) -> Column:
    """Why Unix seconds are no instant of a message: missing, before_epoch, too_far, or ok."""
    return F.when(seconds.isNull(), "missing").when(seconds < 0, "before_epoch").when(seconds > last, "too_far").otherwise("ok")


def liveness(df: DataFrame, peer: Column, ts_seconds: Column, gap_seconds: int = 10) -> DataFrame:
    """(peer, first, last, messages): spells in which no two messages of a peer are `gap_seconds` apart."""
    rows = df.select(peer.alias("peer"), F.timestamp_seconds(ts_seconds).alias("at")).dropna()
    spells = rows.groupBy("peer", F.session_window("at", f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("messages"), F.min("at").alias("first"), F.max("at").alias("last"))
    return spells.select("peer", "first", "last", "messages")


def peers_by_role(df: DataFrame, role: Column) -> DataFrame:
    return df.withColumns({"can_aggregate": role.isin("coordinator", "gateway"), "can_contribute": role.isin("coordinator", "contributor")})
