"""Seeded numbers and names for fixtures: the same on every machine and partitioning."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Constants of the published SplitMix64 generator (fixed values).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def split_mix(seed: int, n: int) -> np.ndarray:
    """`n` 64-bit numbers; the k-th depends on seed and k alone."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (2**64 - 1)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


def uniform(seed: int, n: int) -> np.ndarray:
    """Numbers from -0.5 on and below 0.5."""
    return (split_mix(seed, n) >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5


def linear_parameters(inputs: int, outputs: int, seed: int) -> np.ndarray:
    """Weights and then biases of a linear model, biases a tenth of the size."""
    if inputs < 1 or outputs < 1:
        raise ValueError("invalid_dimensions")
    drawn = uniform(seed, inputs * outputs + outputs)
    drawn[inputs * outputs :] *= 0.1
    return drawn.astype(np.float32)


def linear_forward(parameters: np.ndarray, inputs: int, x: np.ndarray) -> np.ndarray:
    outputs, rest = divmod(len(parameters), inputs + 1)
    if rest or x.shape[-1] != inputs:
        raise ValueError("parameter_length_mismatch")
    return x @ parameters[: inputs * outputs].reshape(outputs, inputs).T + parameters[inputs * outputs :]


def mock_peer(index: int) -> str:
    """The id of the index-th test peer."""
    return hashlib.sha256((b"mock-peer-v1:" + struct.pack("<Q", index)).ljust(40, b"\0")).hexdigest()


def attacked_round(spark: SparkSession, n: int, faulty: int, dim: int, hostile: float, seed: int, around: float = 1.0, spread: float = 0.02) -> DataFrame:
    """(round_id, pos, gradients): n vectors of which the last `faulty` hold `hostile` everywhere and the others values within `spread` of `around`."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1_000_001)) / 1_000_000
    benign = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.lit(around - spread) + draw(i) * (2 * spread)).cast("float"))
    vector = F.when(F.col("id") < n - faulty, benign).otherwise(F.array_repeat(F.lit(hostile).cast("float"), dim))
    return spark.range(n).select(F.lit(seed).cast("long").alias("round_id"), F.col("id").alias("pos"), vector.alias("gradients"))
