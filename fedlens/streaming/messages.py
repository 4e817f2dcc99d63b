"""Live message checks: the stateless filters, the sequence window per sender, and deduplication.

`sequence_stream` keeps, per sender, the largest number accepted and the numbers accepted inside the window
(at most window + 1 of them), so state per sender is bounded however long the stream runs; with `ttl_ms` a
sender that stays silent so long is forgotten (such a query never ends by itself, so leave it out when
running to the end of what is there). It gives the verdicts of the batch form for arrivals in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fedlens.common import sender_form, whole_seconds
from fedlens.operators.messages import SKEW_SECONDS, WINDOW, reject_reason
from fedlens.operators.receipts import Seen, identified, receive

VERDICTS = "peer string, arrival long, sequence long, verdict string"


def judged(numbers: list[int], last: int | None, kept: set[int], window: int) -> tuple[list[str], int | None, set[int]]:
    """Verdicts of one sender's numbers in order of arrival, and the state after them."""
    out = []
    for n in numbers:
        if last is not None and n <= last - window:
            out.append("too_old")
        elif n in kept:
            out.append("replay")
        else:
            out.append("ok")
            last = n if last is None else max(last, n)
            kept.add(n)
            kept = {k for k in kept if k > last - window or k == last}
    return out, last, kept


def sequence_stream(stream: DataFrame, window: int = WINDOW, ttl_ms: int | None = None) -> DataFrame:
    """(peer, arrival, sequence, verdict) of a stream with (sender, sequence, arrival)."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if ttl_ms is not None and state.hasTimedOut:
            state.remove()
            return
        last, kept = (state.get[0], set(state.get[1])) if state.exists else (None, set())
        rows = pd.concat(list(frames)).sort_values("arrival")
        verdicts, last, kept = judged(rows["sequence"].tolist(), last, kept, window)
        state.update((last, sorted(kept)))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"peer": key[0], "arrival": rows["arrival"].to_numpy(), "sequence": rows["sequence"].to_numpy(), "verdict": verdicts})

    rows = stream.select(sender_form(F.col("sender")).alias("peer"), F.col("arrival").cast("long").alias("arrival"), F.col("sequence").cast("long").alias("sequence")).dropna()
    return rows.groupBy("peer").applyInPandasWithState(step, VERDICTS, "last long, kept array<long>", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def accepted_stream(stream: DataFrame, skew: int = SKEW_SECONDS) -> DataFrame:
    """Messages that pass every check without state."""
    return stream.filter(reject_reason(stream, skew).isNull())


def deduplicated_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One receipt of each (sender, sequence, second) among those no further apart than the watermark."""
    keyed = stream.withColumns({"__peer": sender_form(F.col("sender")), "__second": whole_seconds(F.col("ts"))}).withColumn("__at", F.timestamp_seconds("now"))
    return keyed.withWatermark("__at", delay).dropDuplicatesWithinWatermark(["__peer", "sequence", "__second"]).drop("__peer", "__second", "__at")


def counts_per_window(stream: DataFrame, length: str = "1 minute", slide: str | None = None, delay: str = "2 minutes") -> DataFrame:
    """(start, end, message_type, messages) per event-time window; later messages than the watermark are left out."""
    timed = stream.withColumn("at", F.timestamp_seconds(whole_seconds(F.col("ts")))).withWatermark("at", delay)
    sums = timed.groupBy(F.window("at", length, slide) if slide else F.window("at", length), "message_type").agg(F.count(F.lit(1)).alias("messages"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "message_type", "messages")


def received(spark: SparkSession, source: str, schema: str | None = None, **options: object) -> DataFrame:
    """A stream from any source Spark has (kafka, socket, rate, files, ...); bound a batch by the source's own option, such as maxOffsetsPerTrigger."""
    reader = spark.readStream.format(source).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def sent(stream: DataFrame, sink: str, checkpoint: str, **options: object):
    """Start sending a stream to any sink Spark has, to the end of what is there."""
    return stream.writeStream.format(sink).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined_streams(left: DataFrame, right: DataFrame, seconds: int = 60, delay: str = "2 minutes") -> DataFrame:
    """(sender, sequence, first_at, second_at): rows of two streams with (sender, sequence, at) of one identifier at most `seconds` apart.

    Both sides have a watermark and the join a bound in time, so what is held for late partners is bounded too.
    """
    a = left.select(F.col("sender"), F.col("sequence"), F.col("at").alias("first_at")).withWatermark("first_at", delay)
    b = right.select(F.col("sender").alias("b_sender"), F.col("sequence").alias("b_sequence"), F.col("at").alias("second_at")).withWatermark("second_at", delay)
    near = F.expr(f"sender = b_sender and sequence = b_sequence and second_at between first_at - interval {seconds} seconds and first_at + interval {seconds} seconds")
    return a.join(b, near).select("sender", "sequence", "first_at", "second_at")


def exactly_once_sink(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that writes surplus-free batches below `folder` and keeps the seen ranges there.

    The ranges are the only state. A number they cover is looked up in the batches accepted before, of which
    only the row groups with numbers of this batch are read. A batch writes its rows and the ranges so far
    under its number, so a batch run again replaces what it wrote.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        seen = None
        if number > 0:
            low, high = df.agg(F.min("sequence"), F.max("sequence")).first()
            before = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/accepted").filter(F.col("batch") < number)
            if low is not None:
                before = before.filter(F.col("sequence").between(low, high))
            seen = Seen(spark.read.parquet(f"{folder}/ranges/{number - 1}"), identified(before))
        got = receive(df, seen)
        got.accepted(df).write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        got.seen.ranges.write.mode("overwrite").parquet(f"{folder}/ranges/{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
