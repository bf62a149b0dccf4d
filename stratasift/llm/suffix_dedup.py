"""Removal of byte strings that occur earlier in the corpus, by sorting suffixes.

A string of ``window`` bytes is repeated if it also starts earlier.  Which
suffixes have to be sorted against each other is known without sorting all:
every window has an anchor, its smallest hash of ``GRAM`` bytes, so equal
windows have equal anchors, and neighbouring windows with one anchor form a
region.  Regions whose anchor is nowhere else are never sorted.  The others
meet by anchor and are sorted by the deep-shallow method: first whole regions,
of which equal ones become one, then all windows of those that share an anchor
but differ.  Strings of one class are neighbours then, and all but the earliest
are repeated.

Texts are packed in blocks that are written once.  Blocks ask how often their
anchors occur and send their shared regions, packed by bucket, to the tasks
that sort; marks come back by block.  Equal regions of a block are sorted out
before they are sent, and an anchor with very many different regions is dealt
by its whole windows instead, so that no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees_group_memory, frees_memory, quoted, read_table, require, stage, task_count
from .suffix_sorting import deep_shallow_sort

WINDOW_BYTES = 100
GRAM = 24

#: Text in one block, and text for each bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20

#: Anchors with more regions than this, equal ones of a block counted once, are dealt by their windows.
HOT_REGIONS = 20_000

#: Window starts whose anchors are found in one step; places in it have 20 bits.
_SLICE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_NULL_ID = -(1 << 63)

UNIQUE, SHARED, HOT = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(text: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the ``GRAM`` bytes at the places ``at``, or at all of them."""
    if at is None:
        words = np.empty(len(text) - 7, np.uint64)
        raw = text.tobytes()
        for i in range(8):
            words[i::8] = np.frombuffer(raw, "<u8", len(words[i::8]), i)
        n = len(text) - GRAM + 1
        parts = [words[k : k + n] for k in range(0, GRAM, 8)]
    else:
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, GRAM)[at]) if len(at) else np.zeros((0, GRAM), np.uint8)
        parts = list(grams.view("<u8").T)
    value = parts[0] * np.uint64(0x9E3779B97F4A7C15)
    for part in parts[1:]:
        value = ((value ^ (value >> np.uint64(29))) + part) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(value)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def regions_of(text: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the regions of texts that follow one another and end at ``ends``."""
    found = []
    for begin in range(0, max(len(text) - window + 1, 0), _SLICE):
        part = text[begin : begin + _SLICE + window - 1]
        hashes = gram_hashes(part)
        # The smallest hash and, of equal ones, the leftmost.
        least = sliding_min((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), window - GRAM + 1)
        start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        # Windows over the end of a text don't count; texts that end inside begin new regions.
        edges = ends[(ends > begin) & (ends < begin + len(least))] - begin
        start = np.union1d(start, edges)
        text_end = ends[np.searchsorted(ends, start + begin, side="right")] - begin
        stop = np.minimum(np.r_[start[1:], len(least)], text_end - window + 1)
        good = stop > start
        start, stop = start[good], stop[good]
        found.append((start + begin, stop - start, (least[start] & _LOW).astype(np.int64) + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def earliest(classes: np.ndarray, ids: np.ndarray, tags: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the earliest of its class, and whether that is another place."""
    order = np.lexsort((start, tags, ids, classes))
    c = classes[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    head = np.empty(len(c), np.int64)
    head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return head, (ids != ids[head]) | (tags != tags[head]) | (start != start[head])


def _classes(text, at, size, group) -> np.ndarray:
    order, number = deep_shallow_sort(text, at, size, group)
    out = np.empty(len(at), np.int64)
    out[order] = number
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw))


def _unpack(value: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    begin, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, begin))
        begin += size
    return out


#: ids may be null; content is the packed :class:`Block`.
BLOCK = "block long, ids array<long>, content binary"


class Block:
    """Texts that follow one another, with the place of each and the regions that are first of their kind here."""

    def __init__(self, content: bytes):
        self.text, self.lengths, self.tags, windows, offset, self.copied = _unpack(content, np.uint8, np.int64, np.uint64, np.uint8, np.uint8, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.windows, self.offset = windows.astype(np.int64), offset.astype(np.int64)

    @staticmethod
    def packed(ids: list, texts: list[bytes], window: int) -> bytes:
        text = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        tags = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
        start, windows, anchor = regions_of(text, np.cumsum(lengths), window)
        block = Block(_pack(text, lengths, tags, windows.astype(np.uint8), (anchor - start).astype(np.uint8), np.zeros(0, np.int64)))
        key = gram_hashes(text, anchor)
        _, group, times = np.unique(key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[group] > 1)
        classes = _classes(text, start[several], windows[several] + window - 1, group[several])
        doc_ids, doc_tags, place = block.places(ids, start[several])
        head, other = earliest(classes, doc_ids, doc_tags, place)
        # A copy of one at the same place is a repeated row and needs the same marks as the first.
        return _pack(text, lengths, tags, windows.astype(np.uint8), (anchor - start).astype(np.uint8), several[other])

    def starts(self, window: int) -> np.ndarray:
        """Where each region starts: regions cover all windows of all texts, in order."""
        # Windows are counted without those over the ends of texts, so each text shifts its own.
        counts = np.maximum(self.lengths - window + 1, 0)
        counted = np.cumsum(self.windows) - self.windows
        doc = np.searchsorted(np.cumsum(counts), counted, side="right")
        return counted - (np.cumsum(counts) - counts)[doc] + (self.ends - self.lengths)[doc]

    def places(self, ids: list, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, tag, place in the document) of places in the block."""
        doc = np.searchsorted(self.ends, start, side="right")
        numbers = np.array([_NULL_ID if i is None else i for i in ids], np.int64)
        return numbers[doc], self.tags[doc], start - (self.ends - self.lengths)[doc]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def block_table(source: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(key)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield _batch([(number, ids, Block.packed(ids, texts, window))], BLOCK)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _batch([(number, ids, Block.packed(ids, texts, window))], BLOCK)

    return source.mapInArrow(frees_memory(run), BLOCK)


class Anchors:
    """A block's regions that are sent, and their different anchors in the order of buckets."""

    def __init__(self, block: Block, window: int, buckets: int):
        self.start = block.starts(window)
        self.windows = block.windows
        anchor = self.start + block.offset
        self.sent = np.ones(len(self.start), bool)
        self.sent[block.copied] = False
        self.rows = np.flatnonzero(self.sent)
        keys = gram_hashes(block.text, anchor[self.rows])
        self.key, self.inverse, self.times = np.unique(keys, return_inverse=True, return_counts=True)
        bucket = bucket_of(self.key, buckets)
        self.order = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[self.order]
        self.cuts = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]]) if len(sorted_bucket) else np.zeros(0, np.int64)
        self.buckets = sorted_bucket[self.cuts]

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, numbers of its anchors)."""
        for bucket, first, last in zip(self.buckets.tolist(), self.cuts.tolist(), [*self.cuts[1:].tolist(), len(self.order)], strict=True):
            yield bucket, self.order[first:last]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


ASKED = "bucket long, block long, anchors binary"
ANSWERED = "block long, bucket long, kinds binary"


def asked_anchors(blocks: DataFrame, window: int, buckets: int) -> DataFrame:
    """For each block and bucket 32 bits of each different anchor, and how many regions have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Anchors(Block(content.as_py()), window, buckets)
                short = (found.key >> np.uint64(32)).astype(np.uint32)
                times = np.minimum(found.times, 65535).astype(np.uint16)
                rows = [(bucket, number, _pack(short[at], times[at])) for bucket, at in found.parts()]
                if rows:
                    yield _batch(rows, ASKED)

    return blocks.select("block", "content").mapInArrow(frees_memory(run), ASKED)


def anchor_kinds(asked: DataFrame) -> DataFrame:
    """For each block and bucket the kind of each anchor."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(r, np.uint32, np.uint16) for r in table.column("anchors").to_pylist()]
        sizes = [len(s) for s, _ in parts]
        short, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, inverse = np.unique(short, return_inverse=True)
        total = np.bincount(inverse, times)[inverse]
        kinds = np.where(total > HOT_REGIONS, HOT, np.where(total > 1, SHARED, UNIQUE)).astype(np.uint8)
        cut = np.cumsum([0, *sizes])
        packed = [_pack(kinds[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kinds": pa.array(packed, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


#: kind SORT: packed regions; kind MARK: packed marks for ``block``, which need no more sorting.
SENT = "bucket long, block long, kind int, content binary"
SORT, MARK = 0, 1
MARKS = "block long, marks binary"


def _packed_regions(text, ids, tags, place, start, windows, offset, key, window) -> bytes:
    """Regions with their bytes; ``start`` is their place in the block."""
    size = windows + window - 1
    total = np.cumsum(size)
    within = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)
    taken = text[np.repeat(start, size) + within]
    return _pack(taken, key, ids, tags, place, start, windows.astype(np.uint8), offset.astype(np.uint8))


def sent_regions(blocks: DataFrame, kinds: DataFrame, window: int, buckets: int) -> DataFrame:
    """The regions that have to be sorted with those of other blocks, packed by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, ids, content in zip(*[left.column(c).to_pylist() for c in ("block", "ids", "content")], strict=True):
            block = Block(content)
            found = Anchors(block, window, buckets)
            answers = dict(zip(right.column("bucket").to_pylist(), right.column("kinds").to_pylist(), strict=True))
            kind = np.zeros(len(found.key), np.uint8)
            for bucket, at in found.parts():
                kind[at] = _unpack(answers[bucket], np.uint8)[0]
            of_region = kind[found.inverse]
            shared, hot = found.rows[of_region == SHARED], found.rows[of_region == HOT]
            key = found.key[found.inverse]
            if len(shared):
                rows += _by_bucket(block, number, ids, found.start[shared], block.windows[shared], block.offset[shared], key[of_region == SHARED], window, buckets)
            if len(hot):
                start, marked = _hot_windows(block, ids, found.start[hot], block.windows[hot], key[of_region == HOT], window)
                one = np.ones(len(start), np.int64)
                rows += _by_bucket(block, number, ids, start, one, 0 * one, _window_hashes(block.text, start, window), window, buckets)
                if len(marked):
                    rows.append((number % buckets, number, MARK, _pack(marked, np.ones(len(marked), np.uint8))))
        return pa.Table.from_batches([_batch(rows, SENT)])

    return blocks.groupBy("block").cogroup(kinds.groupBy("block")).applyInArrow(frees_group_memory(run), SENT)


def _window_hashes(text: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    raw = text.tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + window]) for s in start.tolist()), np.uint64, len(start))


def _expanded(start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, number of its region)."""
    region = np.repeat(np.arange(len(start)), windows)
    first = np.cumsum(windows) - windows
    return np.repeat(start, windows) + np.arange(len(region)) - first[region], region


def _hot_windows(block: Block, ids: list, start, windows, key, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of hot anchors that are first in the block, and those that are not."""
    at, region = _expanded(start, windows)
    classes = _classes(block.text, at, np.full(len(at), window), key[region])
    _, other = earliest(classes, *block.places(ids, at))
    return at[~other], at[other]


def _by_bucket(block: Block, number: int, ids: list, start, windows, offset, key, window: int, buckets: int) -> list[tuple]:
    doc_ids, tags, place = block.places(ids, start)
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    rows = []
    for at in np.split(order, cuts[1:]):
        columns = [x[at] for x in (doc_ids, tags, place, start, windows, offset, key)]
        rows.append((int(bucket[at[0]]), number, SORT, _packed_regions(block.text, *columns, window)))
    return rows


def sorted_marks(sent: DataFrame, window: int) -> DataFrame:
    """Sorts the regions of each bucket and marks the windows that have an equal one earlier.

    Marks are (first window's place in the block, windows).
    """

    def run(table: pa.Table) -> pa.Table:
        out = []
        kinds = ("bucket", "block", "kind", "content")
        parts, blocks = [], []
        for _, block, kind, content in zip(*[table.column(c).to_pylist() for c in kinds], strict=True):
            if kind == MARK:
                out.append((block, content))
                continue
            parts.append(_unpack(content, np.uint8, np.uint64, np.int64, np.uint64, np.int64, np.int64, np.uint8, np.uint8))
            blocks.append((block, len(parts[-1][1])))
        if parts:
            text, key, ids, tags, place, start, windows, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            block = np.repeat([b for b, _ in blocks], [n for _, n in blocks])
            out += _marks_of(text, key, ids, tags, place, start, windows.astype(np.int64), offset.astype(np.int64), block, window)
        return pa.Table.from_batches([_batch(out, MARKS)])

    return sent.groupBy("bucket").applyInArrow(run, MARKS)


def _marks_of(text, key, ids, tags, place, start, windows, offset, block, window: int) -> list[tuple]:
    size = windows + window - 1
    at = np.cumsum(size) - size
    _, group, times = np.unique(key, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(times[group] > 1)
    if not len(rows):
        return []
    classes = _classes(text, at[rows], size[rows], group[rows])
    head, other = earliest(classes, ids[rows], tags[rows], place[rows])
    marked = [(rows[other], start[rows[other]], windows[rows[other]])]
    # Of equal regions one goes on; repeated rows of one document get its marks.
    first = head == np.arange(len(rows))
    twins = ~other & ~first
    left = rows[first]
    many = np.bincount(group[left], minlength=len(times))[group[left]] > 1
    left = left[many]
    if len(left):
        window_at, region = _expanded(at[left], windows[left])
        nth = window_at - at[left][region]
        of = left[region]
        # Equal windows have their anchor at the same distance.
        _, of_window = np.unique(group[of] * 256 + offset[of] - nth, return_inverse=True)
        found = _classes(text, window_at, np.full(len(window_at), window), of_window)
        _, later = earliest(found, ids[of], tags[of], place[of] + nth)
        of, nth = of[later], nth[later]
        if twins.any() and len(of):
            copies, order = rows[twins], np.argsort(of, kind="stable")
            heads, sorted_of = rows[head[twins]], of[order]
            low, high = np.searchsorted(sorted_of, heads, "left"), np.searchsorted(sorted_of, heads, "right")
            picked, which = _expanded(low, high - low)
            nth = np.concatenate([nth, nth[order][picked]])
            of = np.concatenate([of, copies[which]])
        marked.append((of, start[of] + nth, np.ones(len(of), np.int64)))
    of, begin, count = (np.concatenate(x) for x in zip(*marked, strict=True))
    order = np.lexsort((begin, block[of]))
    of, begin, count = of[order], begin[order], count[order]
    cuts = np.flatnonzero(np.r_[True, block[of][1:] != block[of][:-1]]) if len(of) else np.zeros(0, np.int64)
    return [(int(block[of[p[0]]]), _pack(begin[p], count[p].astype(np.uint8))) for p in np.split(np.arange(len(of)), cuts[1:]) if len(p)]


RESULT = ("n_bytes", "n_removed", "n_spans", "kept")


def cut_texts(blocks: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each document."""
    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.LongType()) for c in RESULT[:3]], T.StructField(RESULT[3], T.BinaryType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, counts, kept = [], [], []
        for own, content in zip(left.column("ids").to_pylist(), left.column("content").to_pylist(), strict=True):
            block = Block(content)
            begins = block.starts(window)[block.copied]
            marked = [(begins, block.windows[block.copied]), *[_unpack(m, np.int64, np.uint8) for m in right.column("marks").to_pylist()]]
            begin, count = (np.concatenate(x).astype(np.int64) for x in zip(*marked, strict=True))
            change = np.bincount(begin, minlength=len(block.text) + 1).astype(np.int64)
            change -= np.bincount(begin + count + window - 1, minlength=len(block.text) + 1)
            gone = np.cumsum(change)[:-1] > 0
            for key, length, end in zip(own, block.lengths.tolist(), block.ends.tolist(), strict=True):
                lost = gone[end - length : end]
                text = block.text[end - length : end]
                ids.append(key)
                if lost.any():
                    spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
                    counts.append((length, int(lost.sum()), spans))
                    kept.append(text[~lost].tobytes())
                else:
                    counts.append((length, 0, 0))
                    kept.append(text.tobytes())
        columns = {"id": pa.array(ids, pa.int64())}
        columns |= {c: pa.array([n[i] for n in counts], pa.int64()) for i, c in enumerate(RESULT[:3])}
        return pa.table(columns | {"kept": pa.array(kept, pa.binary())})

    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(frees_group_memory(run), schema)


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES) -> DataFrame:
    """One row per row: (id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``), ``kept`` being the bytes that stay.

    A byte goes if a string of ``window`` bytes that covers it also starts
    earlier, in a document with a smaller id or earlier in its own; strings
    are those of the input and never cross documents.  ``n_spans`` counts the
    maximal runs that go.  What stays may be cut inside a character.

    Ids are integers (others raise a ValueError); null sorts before all.  Null
    and empty texts have no bytes, texts shorter than a window lose none, and
    texts of any length are judged whole, each within one task.  Different
    texts that share an id have the order of their hashes; rows that are equal
    in both are one document and lose the same bytes.  An empty table gives an
    empty result.  Other columns are not looked at, whatever their names.
    """
    require(df, id_col, text_col)
    if not 2 * GRAM < window <= 200:
        raise ValueError(f"windows have {2 * GRAM + 1} to 200 bytes")
    id_type = df.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise ValueError(f"ids are integers, which {id_col} is not")
    source = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * task_count(source), size // BUCKET_BYTES + 1)
    blocks = stage(block_table(source, window), "blocks")
    kinds = anchor_kinds(asked_anchors(blocks, window, buckets))
    marks = sorted_marks(sent_regions(blocks, kinds, window, buckets), window)
    return cut_texts(blocks, marks, window).withColumn("id", F.col("id").cast(id_type))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, len(x) // 2 AS bytes FROM d),
parts AS (SELECT doc_id, b, array_slice(x, 2 * b + 1, 2 * b + 1198) AS y FROM n, unnest(range(0, bytes, 500)) u(b)),
win AS (SELECT doc_id, b + i AS s, md5(array_slice(y, 2 * i + 1, 2 * i + 200)) AS h FROM parts, unnest(range(0, least(500, len(y) // 2 - 99))) u(i)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
steps AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 100, true) AS new FROM later),
runs AS (SELECT doc_id, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM steps),
spans AS (SELECT doc_id, run, min(s) AS b, max(s) + 100 AS e FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, run, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS p FROM spans),
kept AS (
  SELECT n.doc_id, sum(e - b) AS gone, count(*) AS n_spans, max(e) AS last,
    string_agg(array_slice(x, 2 * p + 1, 2 * b), '' ORDER BY run) AS begun
  FROM pieces JOIN n USING (doc_id) GROUP BY n.doc_id)
SELECT doc_id, bytes AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(begun || array_slice(x, 2 * last + 1, 2 * bytes), x))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""
