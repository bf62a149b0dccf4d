"""Removal of word sequences that occur earlier in the corpus.

A window of words is repeated if the same words also start earlier.  Every
window is assigned to an anchor inside it, its smallest hash of ``ANCHOR``
consecutive words, so equal windows have equal anchors.  Neighbouring windows
with one anchor form a region.  Hashes only decide which texts meet: regions
that share an anchor but differ are a reference shard, turned into a suffix
automaton through which the later regions are streamed, and where the matching
statistics reach the length of a window, the words are repeated.  Regions that
look like copies of an earlier one go with their neighbours as one span, and
both texts' words of the span are compared, which gives the statistics of
equal texts without a walk.  A shard that would outgrow a task is cut by
lengthening its anchor to the whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import (
    binary_list,
    block_of,
    frees_group_memory,
    frees_memory,
    numbered,
    quoted,
    read_table,
    remove_folder,
    require,
    stage,
    stage_at,
    task_count,
)
from .simhash import groups_of

WINDOW_WORDS = 20
ANCHOR = 8

#: Regions in one automaton at most; the anchor of larger shards is lengthened.
MAX_SHARD = 1000

#: Regions that a task compares among themselves before they are sent on.
LOCAL_REGIONS = 250_000

#: Copies that name one document as the earlier one; further ones name the first of their own thousand.
FAN = 1000

#: Bytes of text that meet their requests in one step.
BLOCK_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_WORD_CACHE = 250_000
_NULL_ID = -(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all runs of each length, by doubling."""
    powers = [words]
    while 2 << (len(powers) - 1) <= max(lengths):
        half, p = 1 << (len(powers) - 1), powers[-1]
        powers.append(p[:-half] * np.uint64(pow(_BASE, half, 1 << 64)) + p[half:])
    out = []
    for length in lengths:
        value, done = None, 0
        for bit in range(length.bit_length() - 1, -1, -1):
            if length >> bit & 1:
                part = powers[bit][done : done + len(words) - length + 1]
                value = part if value is None else value * np.uint64(pow(_BASE, 1 << bit, 1 << 64)) + part
                done += 1 << bit
        out.append(value)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def regions_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, start, windows) of a document's regions."""
    if len(words) < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    grams, whole = run_hashes(words, (ANCHOR, window))
    grams = _mix(grams)
    low = np.uint64((1 << 24) - 1)
    # The smallest hash and, of equal ones, the leftmost.
    keyed = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    least = sliding_min(keyed, window - ANCHOR + 1)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    windows = np.diff(np.r_[start, len(least)])
    base = start & ~int(low)
    at = base + (least[start] & low).astype(np.int64)
    at = np.where(at < start, at + int(low) + 1, at)
    first, last = whole[start], whole[start + windows - 1]
    content = _mix(
        _mix(first + np.uint64(1)) * np.uint64(3) + _mix(last + np.uint64(2)) + (windows * 512 + at - start).astype(np.uint64)
    )
    return grams[at].view(np.int64), content.view(np.int64), start, windows


#: A region's place is its first window's, shifted, and how many windows it has.
REGION = "anchor long, content long, id long, place long, head_id long, head_place long"


def _place(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start << 8) | windows


def document_regions(source: DataFrame, window: int) -> DataFrame:
    """Regions of all documents; those that look like an earlier one of their task name it and have no anchor.

    Of the regions of a task that look equal only the earliest goes on to meet
    the others, so a passage in very many documents sends one row per task.
    """

    def settled(parts):
        anchor, content, ids, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, ids, content, anchor))
        anchor, content, ids, place = anchor[order], content[order], ids[order], place[order]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        # Rows of one id at one place are one region, whatever the number of rows.
        copy = (ids != ids[head]) | (place != place[head])
        keep = new | copy
        first = ~copy[keep]
        columns = [
            pa.array(anchor[keep], mask=copy[keep]),
            pa.array(content[keep], mask=copy[keep]),
            pa.array(ids[keep]),
            pa.array(place[keep]),
            pa.array(ids[head][keep], mask=first),
            pa.array(place[head][keep], mask=first),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "id", "place", "head_id", "head_place"])

    def run(batches):
        hashes, parts, size = _WordHashes(), [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), binary_list(batch, "text"), strict=True):
                tokens = text.split()
                if len(tokens) < window:
                    continue
                words = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
                anchor, content, start, windows = regions_of(words, window)
                parts.append((anchor, content, np.full(len(start), key, np.int64), _place(start, windows)))
                size += len(start)
                if size >= LOCAL_REGIONS:
                    yield settled(parts)
                    parts, size = [], 0
        if parts:
            yield settled(parts)

    return source.mapInArrow(frees_memory(run), REGION)


def judged_regions(regions: DataFrame) -> DataFrame:
    """Regions with something to compare.

    Those that look like an earlier one have its ``head_id`` and ``head_place``;
    the first of each look among different ones have their ``anchor``, and
    ``hot`` if too many regions have it.
    """
    met = regions.where("anchor is not null").select("anchor", "content", "id", "place")
    # Most anchors have one region only; the others' rows are told by a join whose skew can be split.
    several = (
        met.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("content").alias("low"), F.max("content").alias("high"))
        .where("rows > 1")
        .select(F.col("anchor").alias("shared"), (F.col("low") != F.col("high")).alias("differ"), (F.col("rows") > MAX_SHARD).alias("hot"))
    )
    rows = met.join(several, F.col("anchor") == F.col("shared")).repartition("anchor", "content")
    of_region = Window.partitionBy("anchor", "content").orderBy("id", "place")
    ranked = rows.withColumns(
        {
            "nth": F.row_number().over(of_region),
            "rank": F.rank().over(of_region),
            "first": F.first(F.struct("id", "place")).over(of_region),
        }
    ).withColumn("part", F.floor((F.col("nth") - 1) / FAN))
    # Any earlier region with the same words will do, so that no document is asked by all copies of it.
    of_part = Window.partitionBy("anchor", "content", "part").orderBy("id", "place")
    named = F.when((F.col("nth") - 1) % FAN == 0, F.col("first")).otherwise(F.first(F.struct("id", "place")).over(of_part))
    ranked = ranked.withColumn("head", named)
    copy = F.col("rank") > 1
    return (
        ranked.where(copy | ((F.col("nth") == 1) & F.col("differ")))
        .select(
            "id",
            "place",
            F.when(~copy, F.col("anchor")).alias("anchor"),
            "hot",
            F.when(copy, F.col("head.id")).alias("head_id"),
            F.when(copy, F.col("head.place")).alias("head_place"),
        )
        .unionByName(
            regions.where("anchor is null").select(
                "id", "place", "anchor", F.lit(False).alias("hot"), "head_id", "head_place"
            )
        )
    )


class SuffixAutomaton:
    """Of several word sequences; added one after the other."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def matching(self, words) -> list[int]:
        """For each word the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(w, 0)
            size = size + 1 if state else 0
            out.append(size)
        return out


#: What a request asks a document for: a region's words, or one side's words of a span.
COMPARE, COPY, HEAD = 0, 1, 2

REQUEST = ("id", "kind", "place", "anchor", "hot", "other_id", "other_place")
ANSWER = "kind int, anchor long, id long, start long, windows long, words binary, head_id long, head_start long"


def block_count(source: DataFrame) -> int:
    """Into so many blocks texts are dealt: by their bytes, and four for each task at least."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * task_count(source), size // BLOCK_BYTES + 1)


def _with_texts(source: DataFrame, keyed: DataFrame, blocks: int, run, schema) -> DataFrame:
    """Joins documents and rows of ``keyed`` by blocks of ids and applies ``run`` to each block."""
    left = source.withColumn("block", block_of("doc", blocks))
    right = keyed.withColumn("block", block_of("id", blocks))
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(frees_group_memory(run), schema)


def requests_of(judged: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("long")
    compare = judged.where("anchor is not null").select(
        "id", F.lit(COMPARE).alias("kind"), "place", "anchor", "hot", nothing.alias("other_id"), nothing.alias("other_place")
    )
    copies = judged.where("anchor is null")
    asked = [compare]
    for kind, mine, other in ((COPY, ("id", "place"), ("head_id", "head_place")), (HEAD, ("head_id", "head_place"), ("id", "place"))):
        asked.append(
            copies.select(
                F.col(mine[0]).alias("id"),
                F.lit(kind).alias("kind"),
                F.col(mine[1]).alias("place"),
                nothing.alias("anchor"),
                F.lit(False).alias("hot"),
                F.col(other[0]).alias("other_id"),
                F.col(other[1]).alias("other_place"),
            )
        )
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


def spans_of(kind, mine, place, other, other_place) -> list[np.ndarray]:
    """Joins neighbouring regions that look like neighbouring regions of one document.

    Both documents join the same rows, so their spans are the same.
    """
    start, other_start, windows = place >> 8, other_place >> 8, place & 255
    order = np.lexsort((start, other_start - start, other, mine, kind))
    kind, mine, other = kind[order], mine[order], other[order]
    start, other_start, windows = start[order], other_start[order], windows[order]
    same = (kind[1:] == kind[:-1]) & (mine[1:] == mine[:-1]) & (other[1:] == other[:-1])
    same &= other_start[1:] - start[1:] == other_start[:-1] - start[:-1]
    # A region may be asked for more than once, for rows that share an id.
    fresh = np.r_[True, ~(same & (start[1:] == start[:-1]))]
    kind, mine, other, start, other_start, windows = (x[fresh] for x in (kind, mine, other, start, other_start, windows))
    same = (kind[1:] == kind[:-1]) & (mine[1:] == mine[:-1]) & (other[1:] == other[:-1])
    same &= (other_start[1:] - start[1:] == other_start[:-1] - start[:-1]) & (start[1:] == start[:-1] + windows[:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    return [kind[first], mine[first], other[first], start[first], other_start[first], np.add.reduceat(windows, first)]


def answers(source: DataFrame, requests: DataFrame, blocks: int, window: int) -> DataFrame:
    """The words of regions that have to be compared, and digests of the words of spans.

    Of regions with a hot anchor each window is a region of its own, with all its words as its anchor.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        column = {c: right.column(c).to_numpy() for c in ("id", "kind", "place")}
        compare = column["kind"] == COMPARE
        spans = ~compare
        wanted: dict[int, tuple[list, list]] = {}
        if compare.any():
            picked = right.filter(pa.array(compare))
            for row in zip(*[picked.column(c).to_pylist() for c in ("id", "place", "anchor", "hot")], strict=True):
                wanted.setdefault(row[0], ([], []))[0].append(row[1:])
        if spans.any():
            picked = right.filter(pa.array(spans))
            parts = spans_of(*[picked.column(c).to_numpy() for c in ("kind", "id", "place", "other_id", "other_place")])
            for kind, mine, other, start, other_start, windows in zip(*[x.tolist() for x in parts], strict=True):
                wanted.setdefault(mine, ([], []))[1].append((kind, other, start, other_start, windows))
        rows: list[tuple] = []
        least: dict[bytes, tuple[int, int]] = {}
        texts, done = left.column("text"), set()
        for i, key in enumerate(left.column("doc").to_pylist()):
            if key not in wanted:
                continue
            text = (texts[i].as_py() or "").encode()
            if (mark := (key, hash(text))) in done:
                continue
            done.add(mark)
            words = text.split()
            regions, asked = wanted[key]
            for place, anchor, hot in regions:
                start, windows = place >> 8, place & 255
                if not hot:
                    part = words[start : start + windows + window - 1]
                    rows.append((COMPARE, anchor, key, start, windows, b" ".join(part), None, None))
                    continue
                for s in range(start, min(start + windows, len(words) - window + 1)):
                    part = b" ".join(words[s : s + window])
                    # Of equal windows the earliest of the block goes on to meet the others'.
                    if (first := least.get(part)) is None:
                        least[part] = (key, s)
                    elif first != (key, s):
                        least[part] = min(first, (key, s))
                        rows.append((COPY, None, *max(first, (key, s)), 1, None, None, None))
            for kind, other, start, other_start, windows in asked:
                digest = hashlib.sha256(b" ".join(words[start : start + windows + window - 1])).digest()
                if kind == COPY:
                    rows.append((COPY, None, key, start, windows, digest, other, other_start))
                else:
                    rows.append((HEAD, None, other, other_start, windows, digest, key, start))
        for part, (key, s) in least.items():
            rows.append((HEAD, None, key, s, 1, part, None, None))
        fields = [f.split(" ") for f in ANSWER.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)})

    return _with_texts(source, requests, blocks, run, ANSWER)


MARK = "id long, start long, windows long"


def automaton_marks(contents: DataFrame, window: int) -> DataFrame:
    """Streams each shard's regions, in order, through the automaton of those before them."""

    def run(batches):
        for anchor, ids, start, words in groups_of(batches):
            rows: list[tuple[int, int, int]] = []
            machine, current = SuffixAutomaton(), None
            for a, key, s, text in zip(anchor.tolist(), ids.tolist(), start.tolist(), words, strict=True):
                part = text.split(b" ")
                if a != current:
                    machine, current = SuffixAutomaton(), a
                else:
                    found = machine.matching(part)
                    rows += [(key, s + e - window + 1, 1) for e, m in enumerate(found) if m >= window]
                machine.add(part)
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "windows"])

    ordered = contents.select("anchor", "id", "start", "words").repartition("anchor")
    return ordered.sortWithinPartitions("anchor", "id", "start").mapInArrow(frees_memory(run), MARK)


def copied_spans(found: DataFrame) -> DataFrame:
    """Spans whose words are those of the span that they look like."""
    keys = ["id", "start", "windows", "head_id", "head_start", "words"]
    theirs = found.where(f"kind = {HEAD} and head_id is not null").select(keys)
    return found.where(f"kind = {COPY} and head_id is not null").join(theirs, keys, "left_semi").select("id", "start", "windows")


def lengthened_marks(found: DataFrame) -> DataFrame:
    """Windows of hot anchors that are not the first with their words.

    With the whole window as anchor a shard is one window, and no two of it are left to be streamed.
    """
    windows = found.where(f"kind = {HEAD} and head_id is null").select("words", "id", "start")
    first = windows.groupBy("words").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
    again = windows.join(first.where("times > 1").drop("times"), "words").where(F.struct("id", "start") != F.col("first"))
    within = found.where(f"kind = {COPY} and head_id is null")
    return again.select("id", "start", F.lit(1).cast("long").alias("windows")).unionByName(within.select("id", "start", "windows"))


def covered_words(marks: list[tuple[int, int]], n_words: int, window: int) -> np.ndarray:
    """Which words the marked windows, given as the first and how many, cover."""
    at = np.array(marks, np.int64)
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, np.minimum(at[:, 0], n_words), 1)
    np.add.at(change, np.minimum(at.sum(axis=1) + window - 1, n_words), -1)
    return np.cumsum(change)[:-1] > 0


def _cut(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the covered words and the white space after them."""
    out, at, copied = [], 0, 0
    spans = []
    for w in words:
        at = text.index(w, at)
        spans.append(at)
        at += len(w)
    spans.append(len(text))
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[copied : spans[begin]])
        copied = spans[end]
    out.append(text[copied:])
    return b"".join(out)


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
    keep_layout: bool = False,
) -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` and ``kept_text`` in place of its text.

    A word goes if a window of ``window`` words that covers it also starts
    earlier, in a document with a smaller id or earlier in its own; windows are
    those of the input.  Kept words are joined by one space, or stand as they
    did in the text with ``keep_layout``.

    Ids are integers (others raise a ValueError); null sorts before all.  Null
    and empty texts have no words, texts shorter than a window lose none, and
    texts of any length are judged whole, each within one task.  Rows that
    share an id are one document: of equal windows at equal places none is
    earlier, and what is removed from one row is removed at the same places of
    the others.  An empty table gives an empty result.  Other columns pass
    through, whatever their names and values, except that columns named like a
    result are replaced.
    """
    require(df, id_col, text_col)
    if not ANCHOR < window <= 200:
        raise ValueError(f"windows have {ANCHOR + 1} to 200 words")
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids are integers, which {id_col} is not")
    added = ("n_words", "n_removed", "kept_text")
    passed = [c for c in df.columns if c not in added and c != text_col]
    key, body = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(_NULL_ID)), F.col(quoted(text_col))
    source = df.select(key.alias("doc"), body.alias("text"))
    blocks = block_count(source)
    # Each table goes as soon as the next one is there.
    regions, regions_at = stage_at(document_regions(source, window), "regions")
    judged, judged_at = stage_at(judged_regions(regions), "judged")
    remove_folder(df.sparkSession, regions_at)
    found = stage(answers(source, requests_of(judged), blocks, window), "answers")
    remove_folder(df.sparkSession, judged_at)
    marks = (
        copied_spans(found)
        .unionByName(automaton_marks(found.where(f"kind = {COMPARE}"), window))
        .unionByName(lengthened_marks(found))
    )
    whole = numbered(df, passed, doc=key, text=body)
    schema = whole.drop("doc", "text").schema
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places: dict[int, list[tuple[int, int]]] = {}
        for key, *mark in zip(*[right.column(c).to_pylist() for c in ("id", "start", "windows")], strict=True):
            places.setdefault(key, []).append(mark)
        n_words, n_removed, kept = [], [], []
        for key, text in zip(left.column("doc").to_pylist(), left.column("text"), strict=True):
            text = (text.as_py() or "").encode()
            words = text.split()
            n_words.append(len(words))
            if (found := places.get(key)) and words:
                gone = covered_words(found, len(words), window)
                n_removed.append(int(gone.sum()))
                kept.append(
                    _cut(text, words, gone)
                    if keep_layout
                    else b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                )
            else:
                n_removed.append(0)
                kept.append(text if keep_layout else b" ".join(words))
        columns = {f"c{i}": left.column(f"c{i}") for i in range(len(passed))}
        columns |= {
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        return pa.table(columns)

    return _with_texts(whole, marks, blocks, run, schema).toDF(*passed, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) u(s)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(s, s + 20)) u(p)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
