"""Language-model scores by prediction by partial matching over bytes.

A text is modelled as its bytes, as they are, and an end symbol.  The trie of
byte contexts is a table of windows: the last ``ORDER`` bytes and the byte that
follows, with its count in the training documents.  Windows and word counts
are gathered per block of documents, summed over all blocks, turned into log
probabilities (escape method C with symbol exclusion) by shards of the trie,
and sent back to the blocks that asked for them.  No table of the model but
that of byte triples is ever in one place, so it grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_list, frees_group_memory, frees_memory, quoted, read_table, require, stage

#: Bytes of context.  A shard of the trie has the last three in common, so it has 2^24 windows at most.
ORDER = 5

#: The end of a text and what stands before its beginning; no UTF-8 text has this byte.
END = 0xFF
ALPHABET = 256

#: Training leaves out documents whose crc32 of the id has this remainder.
FOLDS, HELD_OUT = 7, 2

#: Bytes of text that make up a block, and that are looked at in one step.
BLOCK_BYTES, STEP_BYTES = 32 << 20, 2 << 20

#: The end of a text among the words; no word has white space.
END_WORD = b"\n"


def is_held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % FOLDS == HELD_OUT


def window_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of the texts, and where each text's windows begin.

    A code has the byte to be predicted in its lowest eight bits and the bytes
    before it above.
    """
    end = bytes([END])
    pad = end * ORDER
    flat = np.frombuffer(pad + (end + pad).join(texts) + end, dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    codes = np.zeros(len(flat) - ORDER, np.int64)
    for back in range(ORDER, -1, -1):
        codes <<= 8
        codes |= flat[ORDER - back : len(flat) - back]
    # Targets are all bytes but the padding between the texts.
    padding = (starts[1:-1, None] + np.arange(len(texts) - 1)[:, None] * ORDER + np.arange(ORDER)).ravel()
    return np.delete(codes, padding) if len(padding) else codes, starts


def sorted_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(codes)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.r_[first, len(ordered)])


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of distinct sorted codes and their counts from several."""
    code, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    if not len(code):
        return code, count
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(count, first)


def packed_docs(keys: list, texts: list[bytes]) -> bytes:
    """Ids and texts as one compressed Arrow table, which is what travels to where they are scored."""
    table = pa.table(
        {"key": pa.array([None if k is None else str(k) for k in keys], pa.string()), "text": pa.array(texts, pa.binary())}
    )
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


BLOCK_ROWS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("code", T.LongType()),
        T.StructField("word", T.BinaryType()),
        T.StructField("seen", T.LongType()),
        T.StructField("docs", T.BinaryType()),
    ]
)
BATCH_SCHEMA = pa.schema(
    [("block", pa.int64()), ("code", pa.int64()), ("word", pa.binary()), ("seen", pa.int64()), ("docs", pa.binary())]
)


class Block:
    """Requests and training counts of some documents, gathered in steps."""

    def __init__(self, number: int):
        self.number = number
        self.train, self.rest = Counter(), set()
        self.known: list[tuple] = []
        self.asked: list[np.ndarray] = []
        self.docs: list[bytes] = []

    def add(self, keys: list, texts: list[bytes]) -> None:
        held = [is_held_out(k) for k in keys]
        for text, out in zip(texts, held, strict=True):
            words = text.lower().split()
            if out:
                self.rest.update(words)
            else:
                self.train.update(words)
                self.train[END_WORD] += 1
        self.rest.add(END_WORD)
        codes, starts = window_codes(texts)
        learn = np.repeat(np.array([not h for h in held], bool), np.diff(starts))
        # One table of each kind is kept, not one for every step.
        self.known = [merged_counts([*self.known, sorted_counts(codes[learn])])]
        self.asked = [np.union1d(self.asked[0], codes[~learn]) if self.asked else np.unique(codes[~learn])]
        self.docs.append(packed_docs(keys, texts))

    def _rows(self, n: int, **columns) -> pa.RecordBatch:
        columns["block"] = pa.array(np.full(n, self.number, np.int64))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in BATCH_SCHEMA], schema=BATCH_SCHEMA)

    def rows(self):
        (known, counts), (asked,) = self.known[0], self.asked
        extra = asked[~np.isin(asked, known, assume_unique=True)]
        known, counts = np.r_[known, extra], np.r_[counts, np.zeros(len(extra), np.int64)]
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        for at in range(0, len(known), 200_000):
            part = slice(at, at + 200_000)
            yield self._rows(len(known[part]), code=pa.array(known[part]), seen=pa.array(counts[part]))
        self.rest.difference_update(self.train)
        for words, seen in ((list(self.train), list(self.train.values())), (list(self.rest), [0] * len(self.rest))):
            for at in range(0, len(words), 100_000):
                some = words[at : at + 100_000]
                yield self._rows(len(some), word=pa.array(some, pa.binary()), seen=pa.array(seen[at : at + 100_000], pa.int64()))
        for docs in self.docs:
            yield self._rows(1, docs=pa.array([docs], pa.binary()))


def gathered_blocks(docs: DataFrame) -> DataFrame:
    """Cuts the stream of documents in each task into blocks and gathers what each needs."""

    def run(batches):
        partition, number = TaskContext.get().partitionId(), 0
        block, total = Block(partition << 32), 0
        keys: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), binary_list(batch, "text"), strict=True):
                keys.append(key)
                texts.append(text)
                size += len(text) + 64
                if size >= STEP_BYTES:
                    block.add(keys, texts)
                    total += size
                    keys, texts, size = [], [], 0
                    if total >= BLOCK_BYTES:
                        yield from block.rows()
                        number += 1
                        block, total = Block((partition << 32) | number), 0
        if keys:
            block.add(keys, texts)
        if block.docs:
            yield from block.rows()

    return docs.mapInArrow(frees_memory(run), BLOCK_ROWS)


class Triples:
    """Counts of byte triples over the whole corpus, from which contexts of two bytes, one and none follow."""

    def __init__(self, code: np.ndarray, seen: np.ndarray):
        there = seen > 0
        code, seen = code[there], seen[there]
        order = np.argsort(code)
        self.code, self.seen = code[order], seen[order]
        self.pairs = np.zeros((256, 256), np.int64)
        np.add.at(self.pairs, ((self.code >> 8) & 0xFF, self.code & 0xFF), self.seen)
        context = self.code >> 8
        self.total = [np.bincount(context, self.seen, 1 << 16).astype(np.int64), self.pairs.sum(axis=1), self.pairs.sum()]
        single = self.pairs.sum(axis=0)
        self.kinds = [np.bincount(context, minlength=1 << 16), (self.pairs > 0).sum(axis=1), np.int64((single > 0).sum())]
        # How often the symbols that follow two bytes, or one, stand after one byte, or none.
        after = self.pairs[(self.code >> 8) & 0xFF, self.code & 0xFF]
        self.shut = [np.bincount(context, after, 1 << 16).astype(np.int64), ((self.pairs > 0) @ single)]
        self.single = single

    def own(self, triple: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(triple), np.int64)
        at = np.minimum(np.searchsorted(self.code, triple), len(self.code) - 1)
        return np.where(self.code[at] == triple, self.seen[at], 0)


def log_probabilities(codes: np.ndarray, counts: np.ndarray, low: Triples) -> np.ndarray:
    """log10 probability of the last byte of each window after the bytes before it.

    ``codes`` are distinct and sorted; all windows that agree in the last three
    bytes before the last are among them.  ``counts`` may be zero for windows
    that were asked for and not seen.
    """
    n = len(codes)
    result, waiting = np.zeros(n), np.ones(n, bool)
    symbol, before, two = codes & 0xFF, (codes >> 8) & 0xFF, (codes >> 8) & 0xFFFF
    # What the next longer context has seen: symbols, and how often those stand after the shorter one.
    shut_symbols = np.zeros(n, np.int64)
    seen_above = above_context = None
    for order in range(ORDER, -1, -1):
        if order >= 3:
            node = codes & ((1 << 8 * (order + 1)) - 1)
            nodes, inverse = (codes, slice(None)) if order == ORDER else np.unique(node, return_inverse=True)
            node_count = counts if order == ORDER else np.bincount(inverse, counts, len(nodes)).astype(np.int64)
            contexts, of_node = np.unique(nodes >> 8, return_inverse=True)
            total = np.bincount(of_node, node_count, len(contexts)).astype(np.int64)[of_node][inverse]
            kinds = np.bincount(of_node, node_count > 0, len(contexts)).astype(np.int64)[of_node][inverse]
            own = node_count[inverse]
        else:
            at = (two, before, np.zeros(n, np.int64))[2 - order]
            total, kinds = (np.atleast_1d(x[2 - order])[at] for x in (low.total, low.kinds))
            own = (low.own(codes & 0xFFFFFF), low.pairs[before, symbol], low.single[symbol])[2 - order]
        if seen_above is None:
            shut_total = np.zeros(n, np.int64)
        elif order < 2:
            # The windows at hand need not have all symbols that followed the longer context; the table has.
            shut_total = low.shut[1 - order][two if order else before]
        else:
            # Once for each symbol that the longer context has, how often it stands after this one.
            shut_total = np.zeros(n, np.int64)
            if seen_above.any():
                picked = np.flatnonzero(seen_above)
                if order < ORDER - 1:
                    picked = picked[np.unique(codes[picked] & ((1 << 8 * (order + 2)) - 1), return_index=True)[1]]
                ids, where = np.unique(above_context[picked], return_inverse=True)
                sums = np.bincount(where, own[picked], len(ids)).astype(np.int64)
                place = np.minimum(np.searchsorted(ids, above_context), len(ids) - 1)
                shut_total = np.where(ids[place] == above_context, sums[place], 0)
        open_total, open_kinds = total - shut_total, kinds - shut_symbols
        usable = waiting & (open_total > 0)
        hit = usable & (own > 0)
        whole = np.maximum(open_total + open_kinds, 1)
        result[hit] += np.log10(own[hit] / whole[hit])
        miss = usable & ~hit
        result[miss] += np.log10(open_kinds[miss] / whole[miss])
        waiting &= ~hit
        shut_symbols = kinds
        seen_above = own > 0
        above_context = (codes >> 8) & ((1 << 8 * order) - 1)
    result[waiting] -= np.log10(np.maximum(ALPHABET - shut_symbols[waiting], 1))
    return result


def model_table(windows: DataFrame) -> DataFrame:
    """(code, logp) of every distinct window, by shards of the trie."""
    totals = stage(windows.groupBy("code").agg(F.sum("seen").alias("seen")), "windows")
    # Byte triples: 2^24 at most, whatever the corpus.
    table = totals.groupBy(F.col("code").bitwiseAND(0xFFFFFF).alias("code")).agg(F.sum("seen").alias("seen")).toArrow()
    triples = Triples(*(table.column(c).to_numpy().astype(np.int64) for c in ("code", "seen")))
    shared = windows.sparkSession.sparkContext.broadcast(triples)

    def run(batches):
        codes, counts = [], []
        for batch in batches:
            codes.append(batch.column(0).to_numpy(zero_copy_only=False))
            counts.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not codes or not sum(map(len, codes)):
            return
        code, count = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(code)
        code, count = code[order], count[order]
        logp = log_probabilities(code, count, shared.value)
        for at in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[at : at + 100_000]), pa.array(logp[at : at + 100_000])], names=["code", "logp"]
            )

    shard = F.shiftright("code", 8).bitwiseAND(0xFFFFFF)
    return totals.select("code", "seen", shard.alias("shard")).repartition("shard").select("code", "seen").mapInArrow(
        frees_memory(run), "code long, logp double"
    )


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed by place value."""
    return pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int, kind) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(kind).ravel()


PACKED = "block long, n long, codes binary, words binary, answers binary"


def packed_answers(answers: DataFrame) -> DataFrame:
    """Rows of (block, code or word, value) as one row for each block that a task has some of."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        block = table.column(0).to_numpy()
        key, value = table.column(1), table.column(2).to_numpy()
        if key.type == pa.int64():
            key = key.to_numpy()
            order = np.lexsort((key, block))
            key = key[order]
        else:
            order = np.argsort(block, kind="stable")
            key = key.take(pa.array(order))
        block, value = block[order], value[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        rows: list[tuple] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            codes = words = None
            if isinstance(key, np.ndarray):
                codes = _squeezed(np.diff(key[a:b], prepend=np.int64(0)))
            else:
                joined = b" ".join(key.slice(a, b - a).to_pylist())
                words = pa.compress(joined, codec="zstd", asbytes=True) + len(joined).to_bytes(8, "little")
            rows.append((int(block[a]), b - a, codes, words, _squeezed(value[a:b])))
            if len(rows) == 500 or b == len(block):
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "n", "codes", "words", "answers"]
                )
                rows = []

    def packed(batches):
        for first in batches:
            yield from run(chain([first], batches))

    return answers.mapInArrow(frees_memory(packed), PACKED)


class CodeIndex:
    """Places of distinct codes, by hash tables of which each has what found no room in the one before."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels = codes, []
        left = np.arange(len(codes), dtype=np.int32)
        while len(left):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels))
            shift = np.uint64(62 - int(len(left)).bit_length())
            slots = np.zeros(1 << (64 - int(shift)), np.int32)
            at = (codes[left].view(np.uint64) * factor) >> shift
            slots[at] = left
            self.levels.append((factor, shift, slots))
            left = left[slots[at] != left]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each of the codes is; all must be there."""
        found, open_ = np.zeros(len(wanted), np.int32), None
        for factor, shift, slots in self.levels:
            some = wanted if open_ is None else wanted[open_]
            at = slots[(some.view(np.uint64) * factor) >> shift]
            wrong = np.flatnonzero(self.codes[at] != some)
            if open_ is None:
                found, open_ = at, wrong
            else:
                found[open_], open_ = at, open_[wrong]
            if not len(open_):
                break
        return found


SCORES = "n_tokens long, n_known long, log_known double, score double"


def score_blocks(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Looks every window and word of a block's documents up in what came back for the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        codes, logs = [], []
        for n, packed, words, answer in zip(*[right.column(c).to_pylist() for c in ("n", "codes", "words", "answers")], strict=True):
            if words is None:
                codes.append(np.cumsum(_restored(packed, n, np.int64)))
                logs.append(_restored(answer, n, np.float64))
            else:
                size = int.from_bytes(words[-8:], "little")
                parts = pa.decompress(words[:-8], size, codec="zstd", asbytes=True).split(b" ")
                seen.update(zip(parts, _restored(answer, n, np.int64).tolist(), strict=True))
        index, logp = CodeIndex(np.concatenate(codes)), np.concatenate(logs)
        get, end = seen.__getitem__, seen[END_WORD]
        keys, scores, n_tokens, n_known, log_known = [], [], [], [], []
        for packed in left.column("docs").to_pylist():
            part = pa.ipc.open_stream(packed).read_all()
            texts = part.column("text").to_pylist()
            keys += part.column("key").to_pylist()
            windows, starts = window_codes(texts)
            scores += np.add.reduceat(logp[index.find(windows)], starts[:-1]).tolist()
            for text in texts:
                c = np.array([*map(get, text.lower().split()), end], np.int64)
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                log_known.append(float(np.log10(c + 1).sum()))
        return pa.table(
            {
                "key": pa.array(keys, pa.string()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "log_known": pa.array(log_known, pa.float64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    return docs.groupBy("home").cogroup(answers.groupBy("block")).applyInArrow(frees_group_memory(run), f"key string, {SCORES}")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the model's log10 probability of the text's bytes and its end;
    ``base_score`` that of a unigram model of its words, A-Z lower-cased, with
    one added to each count.  Documents whose id's crc32 leaves the remainder
    :data:`HELD_OUT` are scored and not learned from.

    Null and empty texts are one end.  Repeated rows stay and count as often as
    they occur; a null id is the text ``None`` for the fold and null in the
    result.  Texts of any length are scored whole; one text has to fit in a
    task, with eight bytes for each of its own.  Ids come back in their own
    type.  An empty table gives an empty result; without any training document,
    bytes are equally likely.  Other columns are not looked at.
    """
    require(df, id_col, text_col)
    source = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    blocks = stage(gathered_blocks(source), "blocks")
    windows = blocks.where("code is not null").select("block", "code", "seen")
    words = blocks.where("word is not null").select("block", "word", "seen")
    # Summed before they meet the blocks: a word that all blocks have is one row here.
    totals = stage(words.groupBy("word").agg(F.sum("seen").alias("total")), "words")
    size = totals.where("total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    model = model_table(windows)
    window_answers = packed_answers(windows.select("block", "code").join(model, "code").select("block", "code", "logp"))
    word_answers = packed_answers(words.select("block", "word").join(totals, "word").select("block", "word", "total"))
    docs = blocks.where("docs is not null").select(F.col("block").alias("home"), "docs")
    scored = score_blocks(docs, window_answers.union(word_answers))
    base = float(np.log10(size["n"] + size["v"] + 1))
    remainder = F.pmod(F.crc32(F.coalesce("key", F.lit("None")).cast("binary")), F.lit(FOLDS))
    return scored.select(
        F.col("key").cast(df.schema[id_col].dataType).alias(id_col),
        (remainder == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(size["n"]).cast("long").alias("train_tokens"),
        (F.col("log_known") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
