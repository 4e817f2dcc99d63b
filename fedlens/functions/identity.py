"""Hashes, normal forms, redaction and small text functions, all as Column expressions."""

from __future__ import annotations

import hashlib
import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URI_BYTES, ETAG_BYTES = 2048, 512


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Column) -> Column:
    """Trimmed, with the letters A to Z alone in lower case."""
    return F.translate(trimmed(c), UPPER, LOWER)


def sha256(*parts: Column) -> Column:
    """SHA-256 of the parts in order; null and the empty text differ, and parts can't run into each other."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]), 256)


def node_id(node_key: Column) -> Column:
    """The first 16 bytes of SHA-256 of the key, as hex."""
    return F.substring(F.sha2(node_key, 256), 1, 32)


def peer_id(public_key: Column) -> Column:
    return F.sha2(public_key, 256)


def span_id(node: Column, ts_nanos: Column) -> Column:
    """The first 8 bytes of SHA-256 of the node id's bytes and the instant's eight bytes, high byte first."""
    return F.substring(F.sha2(F.concat(F.unhex(node), F.unhex(F.lpad(F.hex(ts_nanos), 16, "0"))), 256), 1, 16)


def op_hash(op_kind: Column, op_type: Column, code_ref: Column, params: Column) -> Column:
    """What an operator is, wherever it is wired: kind, type, code and parameters."""
    return sha256(F.lit("op.v0"), op_kind, op_type, code_ref, params)


def node_def_hash(op_kind: Column, op_type: Column, code_ref: Column, inputs: Column, outputs: Column, params: Column) -> Column:
    """The same and its wiring; hints, policies and trust are left out."""
    return sha256(F.lit("node.v1"), op_kind, op_type, code_ref, listed(inputs), listed(outputs), params)


def listed(keys: Column) -> Column:
    """An array as one text that keeps order and nulls."""
    return F.concat_ws(",", F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.coalesce(F.concat(F.octet_length(k).cast("string"), F.lit(":"), k), F.lit("-"))))


def redacted(uri: Column) -> Column:
    """User information before the last @ of the authority is replaced."""
    return F.regexp_replace(uri, r"(?s)^(.*?://)[^/?#]*@", "$1<redacted>@")


def without_query(uri: Column) -> Column:
    return F.regexp_replace(uri, r"(?s)[?#].*$", "")


def clean_uri(uri: Column) -> Column:
    """Trimmed, without query and fragment, user information redacted."""
    return redacted(without_query(trimmed(uri)))


def descriptor_error(uri: Column, etag: Column) -> Column:
    """Why a source descriptor is out of bounds (sizes in bytes), or null."""
    return F.when(F.octet_length(uri) > URI_BYTES, "uri_too_long").when(F.octet_length(etag) > ETAG_BYTES, "etag_too_long")


def source_fingerprint(uri: Column, content_type: Column, auth_mode: Column, etag: Column) -> Column:
    return sha256(F.lit("source.v0"), clean_uri(uri), ascii_lower(content_type), ascii_lower(auth_mode), trimmed(etag))


def schema_hash(fmt: Column, canonical: Column) -> Column:
    return F.when(fmt.isNull() & canonical.isNull(), sha256(F.lit("no_schema.v0"))).otherwise(sha256(F.lit("schema.v0"), ascii_lower(fmt), trimmed(canonical)))


def recipe_hash(definition: Column, upstream: Column) -> Column:
    """`upstream`: fingerprints in the order of the inputs."""
    return sha256(F.lit("recipe.v0"), definition, listed(upstream))


def root_recipe() -> Column:
    return sha256(F.lit("root_source.v0"))


def derived_source(asset_key: Column) -> Column:
    return sha256(F.lit("derived.v0"), asset_key)


def dataset_fingerprint(source: Column, schema: Column, recipe: Column) -> Column:
    return sha256(F.lit("dataset.v0"), source, schema, recipe)


def cache_key(definition: Column, upstream: Column, profile: Column) -> Column:
    return sha256(F.lit("cache.v0"), definition, listed(upstream), ascii_lower(profile))


def status_fingerprint(node: Column, key: Column, seq: Column, status: Column) -> Column:
    return sha256(F.lit("status.v0"), node, key, seq, status)


def valid_id(c: Column, digits: int) -> Column:
    """Hex of the right length in either case, and not all zero."""
    return F.coalesce(c.rlike(f"^[0-9a-fA-F]{{{digits}}}$") & ~c.rlike("^0*$"), F.lit(False))


def escaped_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def joined(values: Column) -> Column:
    """Comma-joined, or `none`."""
    return F.coalesce(F.nullif(F.array_join(values, ","), F.lit("")), F.lit("none"))


def shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("?"))


def auth_marker(mode: Column, custom: Column) -> Column:
    return F.when(ascii_lower(mode) == "custom", F.concat(F.lit("custom:"), F.coalesce(custom, F.lit("")))).otherwise(ascii_lower(mode))


def relative_path(path: Column, base: Column) -> Column:
    return F.ltrim(F.replace(F.replace(path, F.lit("\\"), F.lit("/")), base, F.lit("")), F.lit("/"))


def fallback_run_id(*about: object) -> str:
    """A run id where none is given: 32 hex digits, never all zero, the same for the same arguments; by default of this instant and process."""
    about = about or (time.time_ns(), os.getpid())
    made = hashlib.sha256("\x1f".join(map(str, ("run.v0", *about))).encode()).hexdigest()[:32]
    return made if made.strip("0") else "1".zfill(32)
