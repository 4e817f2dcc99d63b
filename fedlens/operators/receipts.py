"""Messages delivered more than once: one copy of each, by seen ranges per producer.

A message is named by (sender key, sequence, whole second). Most producers count upwards, so what was
seen of a producer is a few disjoint ranges of sequence numbers, and they are all the state there is. A
number outside them is new: it is accepted once, by its first receipt, and merged into the ranges. A number
inside them either repeats a message or names another one, because the counter started again or the
identifier is malformed; only those are looked up, by (sender, sequence, second), among the receipts of
earlier batches, wherever these lie (in the source or among what was accepted), and nowhere else.

Scale: receipts are pre-aggregated per number before any shuffle, so a message received a billion times costs
one row per map task; it is these numbers, not the receipts, that are tested against the ranges. Ranges are
cut at multiples of `BLOCK` numbers, so one busy sender spreads over many tasks and the ranges of a (sender,
block) are at most `BLOCK` / 2. The join back to the receipts of repeated numbers splits under adaptive skew
handling, its other side being one row per number.

Defined results: a row without sender, sequence or ts is never surplus and always accepted; rows equal in
all of sender, sequence, second and order are one receipt; other columns may hold anything and have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedlens.common import BLANKS, sender_form, staged, whole_seconds

BLOCK = 1 << 12


@dataclass
class Seen:
    """What earlier batches left: `ranges` (sender, block, lo, hi), the state, and `history` (sender, number, second, at), where covered numbers are looked up."""

    ranges: DataFrame
    history: DataFrame


@dataclass
class Received:
    seen: Seen  #: what this and all earlier batches saw
    find: Callable[[], DataFrame]

    @cached_property
    def surplus(self) -> DataFrame:
        """kept, surplus, sender, number, second"""
        return self.find()

    def accepted(self, batch: DataFrame, order: str = "arrival") -> DataFrame:
        """`batch` without its surplus receipts."""
        gone = self.surplus.select(F.col("surplus").alias("__rx_gone"))
        return batch.join(gone, batch[order] == gone["__rx_gone"], "left_anti").dropDuplicates([order])


OTHER = "0" * 66


def packed(sender: Column) -> Column:
    """A sender key as bytes: 64 hex digits are 32 bytes; any other key has 33 zero bytes in front, so that no two keys meet."""
    bare = F.btrim(sender, F.lit(BLANKS))
    digits = F.when(F.substring(bare, 1, 2).isin("0x", "0X"), F.substring(bare, 3, 2**31 - 1)).otherwise(bare)
    return F.coalesce(F.when(F.octet_length(digits) == 64, F.unhex(digits)), F.concat(F.unhex(F.lit(OTHER)), F.encode(sender_form(sender), "UTF-8")))


def unpacked(key: Column) -> Column:
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).otherwise(F.decode(F.substring(key, 34, 2**31 - 1), "UTF-8"))


def identified(batch: DataFrame, sender: str = "sender", sequence: str = "sequence", ts: str = "ts", order: str = "arrival") -> DataFrame:
    """(sender, number, second, at) of the rows that have an identifier; senders as bytes."""
    c = lambda n: batch[f"`{n}`"]
    rows = batch.select(packed(c(sender)).alias("sender"), c(sequence).cast("long").alias("number"), whole_seconds(c(ts)).alias("second"), c(order).cast("long").alias("at"))
    return rows.dropna(subset=["sender", "number", "second", "at"])


def merged_ranges(numbers: DataFrame) -> DataFrame:
    """Disjoint ranges (sender, block, lo, hi) from ranges or single numbers (sender, block, lo, hi) that may touch or overlap."""
    w = Window.partitionBy("sender", "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    runs = numbers.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("sender", "block", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def joined_ranges(ranges: DataFrame) -> DataFrame:
    """Per sender, the ranges with the cuts at block bounds removed: (sender, lo, hi)."""
    w = Window.partitionBy("sender").orderBy("lo")
    opens = F.when(F.col("lo") > F.lag("hi").over(w) + 1, 1).otherwise(0)
    runs = ranges.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("sender", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(unpacked(F.col("sender")).alias("sender"), "lo", "hi")


def block_of(number: Column) -> Column:
    return F.floor(number / BLOCK)


def tested(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """`numbers` (sender, number, ...) with `covered`: whether a range of the same sender holds the number."""
    packs = ranges.groupBy("sender", "block").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))  # at most BLOCK / 2
    joined = numbers.withColumn("block", block_of(F.col("number"))).join(packs, ["sender", "block"], "left")
    inside = F.exists("__spans", lambda r: F.col("number").between(r["lo"], r["hi"]))
    return joined.withColumn("covered", F.coalesce(inside, F.lit(False))).drop("block", "__spans")


def receive(batch: DataFrame, seen: Seen | None = None, sender: str = "sender", sequence: str = "sequence", ts: str = "ts", order: str = "arrival") -> Received:
    """Find the surplus receipts of `batch` and what is seen after it.

    `seen` comes from the batches before; messages received there are kept, so every copy in `batch` is surplus.
    """
    key = ["sender", "number"]
    rows = identified(batch, sender, sequence, ts, order)
    numbers = rows.groupBy(*key).agg(F.min("at").alias("first"), F.min_by("second", "at").alias("first_second"), F.count(F.lit(1)).alias("n"))
    numbers = numbers.withColumn("covered", F.lit(False)) if seen is None else tested(numbers, seen.ranges)

    def find() -> DataFrame:
        back = staged(rows.join(numbers.filter("n > 1 or covered").drop("n"), key).filter("covered or at > first"), "receipts-repeated")
        again, inside = back.filter("not covered"), back.filter("covered").select(*key, "second", "at")
        plain = again.filter("second = first_second").select(*key, "second", "at", F.col("first").alias("kept"))
        odd = again.filter("second <> first_second").select(*key, "second", "at")
        if seen is not None:
            asked = inside.select(*key, "second").distinct()
            earlier = seen.history.join(asked, [*key, "second"], "left_semi").groupBy(*key, "second").agg(F.min("at").alias("kept"))
            known = staged(inside.join(earlier, [*key, "second"], "left"), "receipts-known")
            plain = plain.unionByName(known.filter("kept is not null"))
            odd = odd.unionByName(known.filter("kept is null").drop("kept"))
        lookup = odd.groupBy(*key, "second").agg(F.min("at").alias("kept"))
        surplus = plain.unionByName(odd.join(lookup, [*key, "second"]).filter("at > kept"))
        return surplus.select("kept", F.col("at").alias("surplus"), unpacked(F.col("sender")).alias("sender"), "number", "second")

    ranges = numbers.filter("not covered").select("sender", block_of(F.col("number")).alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi"))
    if seen is None:
        return Received(Seen(merged_ranges(ranges), rows), find)
    return Received(Seen(merged_ranges(seen.ranges.unionByName(ranges)), seen.history.unionByName(rows)), find)


def receive_in_turn(messages: DataFrame, slices: int = 2, order: str = "arrival", **columns: str) -> Received:
    """A whole table as `slices` batches of equal width in `order`, each tested against the ranges of those before."""
    at = messages[f"`{order}`"].cast("long")
    low, high = messages.agg(F.min(at), F.max(at)).first()
    seen, found = None, []
    edges = [None, *[low + (high - low) * k // slices for k in range(1, slices)], None] if low is not None else [None, None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if lo is None else at > lo
        got = receive(messages.filter(inside if hi is None else inside & (at <= hi)), seen, order=order, **columns)
        found.append(got.find)
        seen = got.seen
    return Received(seen, lambda: reduce(DataFrame.unionByName, [find() for find in found]))


def missing_numbers(ranges: DataFrame) -> DataFrame:
    """The holes between a sender's ranges: (sender, missing_from, missing_to).

    Ranges are ordered within their block, and only one row per block within a sender.
    """
    blocks = ranges.groupBy("sender", "block").agg(F.min("lo").alias("head"))
    after = blocks.select("sender", "block", F.lead("head").over(Window.partitionBy("sender").orderBy("block")).alias("after"))
    inside = F.lead("lo").over(Window.partitionBy("sender", "block").orderBy("lo"))
    rows = ranges.withColumn("inside", inside).join(after, ["sender", "block"]).withColumn("next", F.coalesce("inside", "after"))
    return rows.filter(F.col("next") > F.col("hi") + 1).select(unpacked(F.col("sender")).alias("sender"), (F.col("hi") + 1).alias("missing_from"), (F.col("next") - 1).alias("missing_to"))
