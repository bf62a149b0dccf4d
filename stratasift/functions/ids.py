"""Identifiers, digests and stable buckets as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of chunk identifiers.
CHUNK_NAMESPACE = uuid.NAMESPACE_URL


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def uuid5(name: Column, namespace: uuid.UUID = CHUNK_NAMESPACE) -> Column:
    """Name-based version 5 UUID, from the SHA-1 of namespace and name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1), F.lit(1))

    def part(a, n):
        return F.substr(digest, F.lit(a), F.lit(n))

    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)
    )


def chunk_id(doc_id: Column, content_hash: Column, index: Column, chunk: Column) -> Column:
    name = F.concat_ws(":", doc_id.cast("string"), content_hash, index.cast("string"), sha256(chunk))
    return uuid5(name)


def index_id(chunk: Column, epoch: Column) -> Column:
    return sha256(F.concat_ws(":", chunk, F.coalesce(epoch, F.lit(""))))


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(sha256(c), 1, 16)


def md5_bucket(c: Column, buckets: int = 10_000) -> Column:
    """The MD5 as a 128-bit number, modulo ``buckets``, folded from four 32-bit words."""
    digest, fold = F.md5(c), 2**32 % buckets
    value = F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        value = (value * fold + word) % buckets
    return value


def relevance_key(doc: Column, chunk: Column, source: Column | None = None) -> Column:
    """``doc::chunk``, else the chunk, else the document, else the source."""
    doc, chunk = F.nullif(doc, F.lit("")), F.nullif(chunk, F.lit(""))
    return F.coalesce(
        F.when(doc.isNotNull() & chunk.isNotNull(), F.concat(doc, F.lit("::"), chunk)),
        chunk,
        doc,
        *([F.nullif(source, F.lit(""))] if source is not None else []),
    )


def cache_key(**fields: Column) -> Column:
    """Digest of the fields as JSON in alphabetical order; nulls are written out."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return sha256(F.to_json(ordered, {"ignoreNullFields": "false"}))


def epoch_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
