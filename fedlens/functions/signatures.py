"""Signatures of messages: Ed25519 as published in RFC 8032, over whole Arrow batches of byte columns.

A check is a few thousand multiplications of 256-bit numbers, some milliseconds, and belongs on the rows that
every cheaper check has passed. Not hardened against timing: it verifies, and signs fixtures.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parameters of the curve (fixed values of the standard).
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P

Point = tuple[int, int, int, int]  # X, Y, Z, T with x = X/Z, y = Y/Z, xy = T/Z
ZERO: Point = (0, 1, 1, 0)


def _added(a: Point, b: Point) -> Point:
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    t, z = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = n - m, z - t, z + t, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, a: Point) -> Point:
    out = ZERO
    while k:
        if k & 1:
            out = _added(out, a)
        a = _added(a, a)
        k >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _root(square: int, odd: int) -> int | None:
    """x with x^2 = square and the lowest bit asked for."""
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def point(data: bytes) -> Point | None:
    """The point 32 bytes stand for, or none."""
    if len(data) != 32:
        return None
    y, odd = int.from_bytes(data, "little") & (2**255 - 1), data[31] >> 7
    if y >= P:
        return None
    x = _root((y * y - 1) * pow(D * y * y + 1, -1, P) % P, odd)
    return None if x is None else (x, y, 1, x * y % P)


def packed(a: Point) -> bytes:
    inverse = pow(a[2], -1, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


BASE = point((4 * pow(5, -1, P) % P).to_bytes(32, "little"))


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (2**254 - 8) | 2**254, h[32:]


def public_key(seed: bytes) -> bytes:
    """Of a seed of 32 bytes that aren't all zero."""
    if len(seed) != 32 or not any(seed):
        raise ValueError("invalid_seed")
    return packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _secret(seed)
    public = public_key(seed)
    r = _number(prefix, message) % ORDER
    head = packed(_times(r, BASE))
    return head + ((r + _number(head, public, message) * scalar) % ORDER).to_bytes(32, "little")


def checked(public: bytes | None, message: bytes | None, signature: bytes | None) -> str:
    """ok, invalid_key, missing_signature or invalid_signature."""
    key = point(public) if public is not None and any(public) else None
    if key is None:
        return "invalid_key"
    if signature is None:
        return "missing_signature"
    head = point(signature[:32]) if len(signature) == 64 else None
    s = int.from_bytes(signature[32:], "little")
    if message is None or head is None or s >= ORDER:
        return "invalid_signature"
    hashed = _number(signature[:32], public, message) % ORDER
    return "ok" if _same(_times(s, BASE), _added(head, _times(hashed, key))) else "invalid_signature"


@F.pandas_udf(T.StringType())
def verdict(public: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([checked(*row) for row in zip(public, message, signature, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def on_curve(public: pd.Series) -> pd.Series:
    return public.map(lambda b: b is not None and any(b) and point(b) is not None)


def samples(spark: SparkSession, n: int) -> DataFrame:
    """(no, public, message, signature): of three rows one is right, one was altered, one has a key that is no point."""
    off = next(b for b in ((k).to_bytes(32, "little") for k in range(2, 100)) if point(b) is None)
    rows = []
    for no in range(n):
        seed, message = hashlib.sha256(f"seed {no}".encode()).digest(), f"message {no}".encode()
        rows.append((no, off if no % 3 == 2 else public_key(seed), message + b"!" * (no % 3 == 1), sign(seed, message)))
    return spark.createDataFrame(rows, "no long, public binary, message binary, signature binary")
