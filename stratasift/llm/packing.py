"""Shortest-pack-first packing over the histogram of lengths.

Token counts go to the driver only as a histogram with at most ``capacity``
entries.  Lengths are placed longest first, each piece into the pack that is
the shortest at that moment; packs that are equally full take theirs in one
step.  A pattern is a list of lengths with the number of packs that have it.
Patterns then meet the pieces by their rank within their length.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe_counts import byte_symbols
from .common import binary_list, plain_list, quoted, read_table, require, stage

CAPACITY = 2048
END_ID = 1

#: Chunks whose ids one Python worker keeps in its newer generation; the older one has as many at most.
CACHE_CHUNKS = 400_000

#: Into so many parts the pieces of one length are dealt for ranking.
RANK_PARTS = 512


#: Separates chunks that are encoded together; a chunk with it is encoded by itself.
_MARK = "\x01"


def _lowers_and_splits_letters(spec: dict) -> bool:
    """Whether a vocabulary file lower-cases text and makes each run of letters one byte-level pre-token."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in before] == ["Split", "ByteLevel"]
        and r"|[\p{L}]+|" in str(before[0]["pattern"].get("Regex"))
        and not before[1]["add_prefix_space"]
        and spec["model"]["type"] == "BPE"
        and not any(t["content"].isalpha() for t in spec["added_tokens"])
    )


class _Seen(dict):
    """Ids of chunks, in two generations.

    Notes the chunks that it was asked for and doesn't have, and gives None for them.
    """

    def __init__(self):
        self.asked: list[bytes] = []
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes | None:
        ids = self.older.get(chunk)
        if ids is None:
            self.asked.append(chunk)
        else:
            self[chunk] = ids
        return ids

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


class ChunkEncoder:
    """Ids of texts, by chunks between ASCII white space, which the tokenizer drops."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # One thread per task is what the cluster's scheduler counts on.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = _Seen()
        (self.mark,) = self._ids(_MARK)
        self.symbols = byte_symbols()
        with open(path, encoding="utf-8") as f:
            self.splits_letters = _lowers_and_splits_letters(json.load(f))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def plain_ids(self, word: bytes) -> bytes | None:
        """Ids of a lower-case word of letters, straight from the merges; None for all other chunks.

        Such a word is a pre-token by itself, and the normalizer leaves it alone.
        """
        if not self.splits_letters:
            return None
        if word.isalpha() and word.islower():
            shown = word.decode()
        else:
            text = word.decode()
            # Letters below the combining marks are composed already.
            if not text.isalpha() or max(text) >= "\u0300" or text.lower() != text:
                return None
            shown = "".join([self.symbols[b] for b in word])
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encoded(self, chunks: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk, from one call for all."""
        texts = [c.decode() for c in chunks]
        joined = f" {_MARK} ".join("" if _MARK in t else t for t in texts)
        ids = np.array(self._ids(joined), dtype="<u4")
        marks = np.flatnonzero(ids == self.mark)
        raw = ids.tobytes()
        begins = [0, *((marks + 1) * 4).tolist()]
        found = [raw[i:j] for i, j in zip(begins, [*(marks * 4).tolist(), len(raw)], strict=True)]
        for i, t in enumerate(texts):
            if _MARK in t:
                found[i] = np.array(self._ids(t), dtype="<u4").tobytes()
        return found

    def learn(self, chunks: list[bytes]) -> None:
        """Finds the ids of new chunks, by the lower-cased word and its final punctuation, which are encoded apart."""
        cache, older = self.cache, self.cache.older
        wanted: dict[bytes, None] = {}
        forms: list[tuple[bytes, bytes, bytes]] = []
        for c in chunks:
            if c.isalpha() and c.islower():  # plain lower-case ASCII, which is most of them
                wanted[c] = None
                continue
            if b"<|" in c:  # special tokens are found before letters are lower-cased
                wanted[c] = None
                continue
            low = c.lower()
            body = low.rstrip(b".,;:!?")
            # Only after a letter does punctuation begin a token of its own.
            if len(body) == len(low) or not body or not (body[-1:].isalpha() or body.decode()[-1].lower().isalpha()):
                body = low
            if body == c:
                wanted[c] = None
                continue
            end = low[len(body) :]
            forms.append((c, body, end))
            for x in (body, end):
                if x and x not in cache:
                    if (ids := older.get(x)) is None:
                        wanted[x] = None
                    else:
                        cache[x] = ids
        missing = []
        for w in wanted:
            if (ids := self.plain_ids(w)) is None:
                missing.append(w)
            else:
                cache[w] = ids
        for i in range(0, len(missing), 2048):
            some = missing[i : i + 2048]
            cache.update(zip(some, self.encoded(some), strict=True))
        for c, body, end in forms:
            cache[c] = cache[body] + cache[end] if end else cache[body]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            cache.age()
        looked_up = [list(map(cache.__getitem__, t.split())) for t in texts]
        if not cache.asked:
            return [b"".join(ids) for ids in looked_up]
        asked, cache.asked = cache.asked, []
        self.learn(list(dict.fromkeys(asked)))
        missed = iter(asked)
        for ids in looked_up:
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = cache[next(missed)]
        return [b"".join(ids) for ids in looked_up]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tokenized_pieces(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = True,
) -> DataFrame:
    """Cuts each document's ids, ``end_id`` appended, into pieces of at most ``capacity``.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``source_row`` (tells repeated rows apart) and, on request, ``ids``.
    """
    source = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "source_row"):
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder, row = encoder_for(tokenizer_path), 0
        for batch in batches:
            keys = plain_list(batch, id_col)
            for lo in range(0, len(keys), 128):
                cols: list[list] = [[] for _ in schema.fields]
                part = encoder.encode(binary_list(batch.slice(lo, 128), "__text"))
                for key, ids in zip(keys[lo : lo + 128], part, strict=True):
                    ids += end
                    total, row = len(ids) // 4, row + 1
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        values = [key, start, len(piece) // 4, zlib.crc32(piece), total, row]
                        if with_ids:
                            values.append(np.frombuffer(piece, dtype="<i4"))
                        for c, v in zip(cols, values, strict=True):
                            c.append(v)
                types = [batch.schema.field(id_col).type] + [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names
                )

    return source.mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (packs, [(length, how many in each pack), ...]).

    Longest lengths first; each piece goes into the pack that is the shortest
    at that moment, if it fits there, and else opens a new one.  Packs that are
    equally full are one group and take a piece each in one step, so the work
    depends on the number of lengths, not of pieces.  A length splits one group
    at most, so there are three patterns for a length at most.
    """
    # By fill: [packs, contents] of each pattern, contents being a chain of lengths from the last back.
    groups: dict[int, list[list]] = {}
    fills: list[int] = []

    def put(fill: int, entries: list[list]) -> None:
        if fill not in groups:
            groups[fill] = []
            heapq.heappush(fills, fill)
        groups[fill] += entries

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        while left and fills and fills[0] + length <= capacity:
            fill = heapq.heappop(fills)
            entries, filled = groups.pop(fill), []
            while entries and left:
                packs, contents = entries.pop()
                taken = min(packs, left)
                left -= taken
                filled.append([taken, (contents, length)])
                if taken < packs:
                    entries.append([packs - taken, contents])
            if entries:
                put(fill, entries)
            put(fill + length, filled)
        if left:
            # No pack has room: a new one is the shortest until it is full.
            full, rest = divmod(left, capacity // length)
            for packs, each in ((full, capacity // length), (1, rest)):
                if packs and each:
                    contents = None
                    for _ in range(each):
                        contents = (contents, length)
                    put(each * length, [[packs, contents]])
    merged: Counter = Counter()
    for entries in groups.values():
        for packs, contents in entries:
            runs: list[list[int]] = []
            while contents:
                contents, length = contents
                if runs and runs[-1][0] == length:
                    runs[-1][1] += 1
                else:
                    runs.append([length, 1])
            merged[tuple(map(tuple, reversed(runs)))] += packs
    return [(packs, list(contents)) for contents, packs in sorted(merged.items(), reverse=True)]


def slot_rows(patterns) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for every place in every pattern."""
    rows, base, ranks = [], 0, Counter()
    for packs, contents in patterns:
        offset = 0
        for length, each in contents:
            for _ in range(each):
                rows.append((length, ranks[length], packs, base, offset))
                ranks[length] += packs
                offset += length
        base += packs
    return rows


def ranked_within_length(pieces: DataFrame, id_col: str) -> DataFrame:
    """Adds ``rank``, dense from 0 within each length.

    Each length is dealt into parts; rows are numbered within a part, and the
    parts' sizes give where each begins.  No task sees all rows of a length.
    """
    parts = pieces.withColumn(
        "part", F.pmod(F.xxhash64(id_col, "start", "source_row", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")
    )
    begins = (
        parts.groupBy("length", "part")
        .count()
        .withColumn(
            "begin",
            F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"),
        )
        .drop("count")
    )
    order = Window.partitionBy("length", "part").orderBy(id_col, "start", "source_row", "ids_crc32", "doc_tokens")
    numbered = parts.withColumn("k", F.row_number().over(order) - 1)
    return (
        numbered.join(begins, ["length", "part"])
        .withColumn("rank", F.col("begin") + F.col("k"))
        .drop("part", "begin", "k")
    )


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces from :func:`tokenized_pieces`.

    ``pieces`` must be stable when read twice (a staged table).  The histogram
    has at most ``capacity`` entries, so patterns and slots are bounded too.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = slot_rows(pack_histogram(histogram, capacity))
    by_length: dict[int, list] = {}
    for length, first, count, base, offset in slots:
        by_length.setdefault(length, []).append((first, count, base, offset))
    tables = {k: np.array(v, dtype=np.int64) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)
    ranked = ranked_within_length(pieces, id_col)
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, table = np.flatnonzero(length == n), shared.value[int(n)]
                at = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                sequence[rows] = table[at, 2] + rank[rows] - table[at, 0]
                offset[rows] = table[at, 3]
            kept = [c for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in kept] + [pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, schema)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = True,
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: the id column, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, on request,
    ``ids``.  A null or empty text is the end token alone.  Documents longer
    than a sequence are cut into full sequences and a rest.  Repeated rows are
    packed as often as they occur; a null id is an id.  An empty table gives an
    empty result.  Columns other than the id and the text are not looked at.
    An id column that is named like a result is returned as ``id``.
    """
    require(df, id_col, text_col)
    named = df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__body"))
    pieces = stage(
        tokenized_pieces(named, tokenizer_path, "__id", "__body", end_id, capacity, with_ids), "pieces"
    )
    packed = pack(pieces, "__id", capacity).drop("source_row")
    return packed.withColumnRenamed("__id", "id" if id_col in packed.columns else id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
