"""A bounded, repeatable sample for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 4


def bounded_sample(rows: DataFrame, total: int, key: str, size: int) -> DataFrame:
    """At most `size` rows, those of the smallest hash of `key`.

    `total` is the number of rows of the table they come from: where it exceeds `SLACK` * size, rows of a
    larger hash are left out where they are read, so that ordering the rest is small work at any scale.
    """
    if total > SLACK * size:
        share = SLACK * size / total
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64(key), 11) < F.lit(int(share * (1 << 53))))
    return rows.orderBy(F.xxhash64(key), key).limit(size)
