"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits.  Of two
errors at least one segment is free, and in one of the ordered pairs (1,2),
(2,3), (3,1) the first segment is free and the second has one error at most.
So a fingerprint gets, for each such pair, one key for each codeword within
four bits of the second segment, with the first segment as it is: fingerprints
within two bits share a key.  Buckets are verified where they meet and give
back a spanning forest of the true links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_list, quoted, read_table, require, stage
from .components import connected_components
from .golay import codeword_indices

SEED = 42
#: (shift, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
MAX_DISTANCE = 2

#: Larger buckets are linked through their one-bit neighbourhoods.
PAIRWISE_BUCKET = 48


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The id and ``fp`` (the 64 bits as a signed long) of each row."""
    source = df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text"))
    schema = source.select("__id").schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t.lower().split(), shingle)) for t in binary_list(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["__id", "fp"])

    return source.mapInArrow(run, schema)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for every key of every fingerprint."""
    bits = fp.view(np.uint64)
    segments = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    keys, rows = [], []
    for number, (exact, fuzzy) in enumerate(PAIRS):
        index = codeword_indices(segments[fuzzy])
        row, column = np.nonzero(index >= 0)
        keys.append((np.int64(number) << 34) | (segments[exact][row] << 12) | index[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if len(fp):
                key, row = golay_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return distinct.mapInArrow(run, "key long, fp long")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Column arrays of a sorted stream, cut only where the first column changes."""
    # Parts that end with one key, joined when it is over.
    rest: list[list[np.ndarray]] = []

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if rest and rest[-1][0][-1] == now[0][-1]:
            rest.append(now)
            continue
        cut = np.searchsorted(now[0], now[0][-1], side="left")
        if rest or cut:
            yield joined([*rest, [c[:cut] for c in now]])
        rest = [[c[cut:] for c in now]]
    if rest:
        yield joined(rest)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links."""
    parent: dict = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    us, vs = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            parent[p] = q
            us.append(x)
            vs.append(y)
    return us, vs


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``distance`` bits between fingerprints of equal keys; sorted by key and fingerprint."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    us, vs = [], []
    size_of = np.repeat(sizes, sizes)
    small = size_of <= PAIRWISE_BUCKET
    k, f = key[small], fp[small]
    for shift in range(1, min(PAIRWISE_BUCKET, len(k))):
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        x, y = f[:-shift][same], f[shift:][same]
        apart = np.bitwise_count((x ^ y).view(np.uint64))
        link = (apart <= distance) & (apart > 0)
        us.append(x[link])
        vs.append(y[link])
    for start, size in zip(starts[sizes > PAIRWISE_BUCKET], sizes[sizes > PAIRWISE_BUCKET], strict=True):
        members = np.unique(fp[start : start + size])
        # Fingerprints within two bits share a word within one bit of both.
        flips = np.r_[0, np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)).view(np.int64)]
        if distance < 2:
            flips = flips[:1]
        word = (members[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(members, len(flips))
        order = np.lexsort((owner, word))
        word, owner = word[order], owner[order]
        same = word[1:] == word[:-1]
        x, y = owner[:-1][same], owner[1:][same]
        if distance == 1:
            word = np.sort(members)
            near = members[:, None] ^ np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)).view(np.int64)[None, :]
            hit = np.isin(near, word)
            x, y = np.repeat(members, hit.sum(axis=1)), near[hit]
        a, b = _forest(x, y)
        us.append(np.array(a, np.int64))
        vs.append(np.array(b, np.int64))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(us) if us else empty), (np.concatenate(vs) if vs else empty)


def fingerprint_links(distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (``u``, ``v``) that connect all distinct fingerprints within ``distance`` bits."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError("the keys guarantee distances of 0 to 2")

    def run(batches):
        for key, fp in groups_of(batches):
            u, v = bucket_links(key, fp, distance)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    keyed = _keyed(distinct).repartition("key").sortWithinPartitions("key", "fp")
    return keyed.mapInArrow(run, "u long, v long")


def simhash_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """The id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows whose fingerprints are linked, directly or through others, share the
    smallest id among them.  Null and empty texts have fingerprint zero and are
    linked like any other; texts with fewer words than a shingle are one
    shingle, and texts of any length are taken whole.  Repeated rows stay; a
    null id never names a component unless all ids in it are null.  A bit that
    exactly half of the hashes have is not set.  An empty table gives an empty
    result.  Other columns are not looked at, whatever their names; an id
    column that is named like a result is returned as ``id``.
    """
    require(df, id_col, text_col)
    prints = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("__id").alias("least"))
    labels = connected_components(fingerprint_links(prints.select("fp").distinct(), distance))
    classes = distinct.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label")
    )
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "label").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("__id").alias("id" if id_col in ("fingerprint", "component_id") else id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs)
