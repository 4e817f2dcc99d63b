"""Distinct rows of a table of which few repeat, without a shuffle of the others.

Hashes that occur more than once are found by an aggregate of hashes alone and set as bits of a map of
`BITS` bits. Rows whose bit is not set cannot repeat and stay where they are; only the others are
compared as whole rows. The result is exact whatever the hashes do: a hash met by chance, or a full map,
only sends more rows the long way.

Scale: a shuffle of 8 bytes for each row and of the rows that may repeat; the map is broadcast and has
`BITS` / 8 bytes at most. Equal rows of one task are one before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedlens.common import staged

BITS = 1 << 26
BUCKET = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def distinct_rows(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """`rows` without repeats; columns may hold anything that can be compared, null being equal to null."""
    hashed = rows.withColumn("__place", F.pmod(F.xxhash64(*rows.columns), F.lit(bits)))
    both = rows.select(F.xxhash64(*rows.columns).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.pmod("h", F.lit(bits)).alias("place"))
    maps = both.groupBy((F.floor(F.col("place") / F.lit(BUCKET))).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("place") % BUCKET).alias("__map"))
    maps = staged(maps, "distinct-maps")  # bits / BUCKET rows of BUCKET / 8 bytes at most
    marked = hashed.withColumn("__bucket", F.floor(F.col("__place") / F.lit(BUCKET))).join(F.broadcast(maps), "__bucket", "left")
    may = F.coalesce(F.expr(f"getbit(cast(conv(hex(substring(__map, cast((__place % {BUCKET}) div 8 as int) + 1, 1)), 16, 10) as int), cast(__place % 8 as int))"), F.lit(0)) == 1
    return marked.filter(~may).select(*rows.columns).unionByName(marked.filter(may).select(*rows.columns).distinct())
