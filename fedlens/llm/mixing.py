"""Mixing sources to target shares of all tokens, with a cap on repeats.

Tokens are summed per source; the rate of a source is its share of the wanted total over its tokens. Every
document is emitted floor(rate) times, plus once more with probability equal to the fraction, decided by a
hash of seed and id, so the mix is the same however the data are partitioned. A few long texts can make such
draws miss a share, so each source has `SEEDS` candidate seeds, weighed in one aggregate over all documents,
and uses the one whose draws come nearest to the tokens wanted.

Without a wanted total the largest one is taken at which every source reaches its share within its cap.
With one, a source whose cap is too low contributes all it may and falls short; the shares reached are
reported either way.

Scale: one pass to count tokens, an aggregate of one row per source, and a map; nothing else is shuffled.

Defined results: sources are compared without case, blanks around, and with `_` or blanks as `-`; documents
of no listed source, null included, are not in the mix; a listed source without tokens contributes nothing
and doesn't count towards the total; an empty table gives an empty mix; no document occurs more often than
its source's cap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedlens.common import plain

SEED, SEEDS = 20_240_917, 32


def source_form(source: Column) -> Column:
    return F.regexp_replace(plain(source), "[_ ]+", "-")


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies per document of each source; `targets` has (share, most copies)."""
    able = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and tokens.get(s)}
    if total is None:
        total = min((cap * tokens[s] / share for s, (share, cap) in able.items()), default=0.0)
    out = {}
    for s, (share, cap) in able.items():
        rate = share * total / tokens[s]
        out[s] = float(round(rate)) if math.isclose(rate, round(rate), rel_tol=1e-12) else rate
        out[s] = min(out[s], float(cap))
    return out


def chance(seed: Column) -> Column:
    """A number from 0 on and below 1 from seed and id."""
    return F.shiftrightunsigned(F.xxhash64(seed, F.col("id")), 11) / F.lit(float(1 << 53))


def by_source(values: dict[str, float | int], otherwise: float | int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(v))]), F.col("source")), F.lit(otherwise)) if values else F.lit(otherwise)


def chosen_seeds(listed: DataFrame, rate: dict[str, float], tokens: dict[str, int], seed: int, seeds: int) -> dict[str, int]:
    """Per source, of the seeds from `seed` on the one whose extra copies hold most nearly the fraction of its tokens."""
    part = {s: r - math.floor(r) for s, r in rate.items()}
    drawn = [F.sum(F.when(chance(F.lit(seed + k)) < by_source(part, 0.0), F.col("tokens")).otherwise(0)).alias(str(k)) for k in range(seeds)]
    rows = listed.groupBy("source").agg(*drawn).collect()  # a row per listed source
    return {r["source"]: seed + min(range(seeds), key=lambda k: (abs((r[str(k)] or 0) - part[r["source"]] * tokens[r["source"]]), k)) for r in rows if r["source"] in part}  # noqa: B023


def mix(sizes: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, seed: int = SEED, seeds: int = SEEDS) -> tuple[DataFrame, dict[str, float], dict[str, int]]:
    """(id, source, tokens, copy) for (id, source, tokens), the rates, and the tokens of each source."""
    listed = sizes.withColumn("source", source_form(F.col("source")))
    listed = listed.filter(F.col("source").isin(*targets) if targets else F.lit(False))
    tokens = {r["source"]: int(r["t"] or 0) for r in listed.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row per listed source
    rate = rates(tokens, targets, total)
    seed_of = chosen_seeds(listed, rate, tokens, seed, seeds)
    value = by_source(rate, 0.0)
    copies = (F.floor(value) + F.when(chance(by_source(seed_of, seed)) < value - F.floor(value), 1).otherwise(0)).cast("int")
    wanted = listed.withColumn("copies", copies).filter("copies > 0")
    return wanted.select("id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), rate, tokens


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]], rate: dict[str, float], tokens: dict[str, int]) -> DataFrame:
    """Per listed source what was wanted and what was reached."""
    spark = mixed.sparkSession
    wanted = spark.createDataFrame([(s, float(share), int(cap), float(rate.get(s, 0.0)), int(tokens.get(s, 0))) for s, (share, cap) in sorted(targets.items())], "source string, target_share double, max_repeats int, rate double, source_tokens long")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_rows"), F.max("copy").alias("most_copies"))
    every = mixed.agg(F.sum("tokens").alias("all_tokens"))
    out = wanted.join(got, "source", "left").join(F.broadcast(every))  # one row
    return out.select("source", "target_share", "max_repeats", "rate", "source_tokens", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mix_tokens", "mix_rows", "most_copies")], F.coalesce(F.try_divide("mix_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"))
