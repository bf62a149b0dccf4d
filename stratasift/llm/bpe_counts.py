"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token is a linked list of byte symbols and a heap of its adjacent pairs.
The lowest-ranked pair (the leftmost of equal ones) is popped and merged until
none is left; the count is the initial symbols minus the merges, and no token
ids are made.  Texts are first cut at white space into chunks that the split
pattern never looks across, and a bounded cache keeps the counts of chunks.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, plain_list, quoted, read_table, require

#: Tokens above which a document is over the limit.
LIMIT = 512

#: Chunks whose counts one Python worker keeps; a full cache starts anew.
CACHE_CHUNKS = 600_000

#: Unicode's White_Space characters, as the split pattern's ``\s`` has them.
_WS = "\t-\r \x85\xa0  -     　"

#: A white-space-free run with the one space before it, or the white space
#: before such a run without its last character, or that last character.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under a byte-level merge list."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.symbols = byte_symbols()
        self.pattern = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
        )
        self.cache: dict[str, int] = {}
        self.cache_chunks = cache_chunks

    def merged(self, token: str) -> int:
        """Symbols of one pre-token that are left when no pair can be merged."""
        part = [self.symbols[b] for b in token.encode()]
        n = len(part)
        if n < 2:
            return n
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # Entries of symbols that have changed or gone since are stale.
            if part[i] is None or j >= n or ranks.get((part[i], part[j])) != rank:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def chunk(self, chunk: str) -> int:
        count = sum(map(self.merged, self.pattern.findall(chunk)))
        if len(self.cache) >= self.cache_chunks:
            self.cache.clear()
        if len(chunk) <= 256:
            self.cache[chunk] = count
        return count

    def plain(self, text: str) -> int:
        get, total = self.cache.get, 0
        for c in _CHUNK.findall(text):
            k = get(c)
            total += self.chunk(c) if k is None else k
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token."""
        if self.special and any(s in text for s in self.special):
            parts = self.special_re.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


_COUNTERS: dict[str, MergeCounter] = {}


def counter_for(path: str) -> MergeCounter:
    """One counter per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row of ``df``, without a shuffle.

    A null text counts as empty and has no tokens.  Repeated rows stay.  Texts
    of any length are counted whole.  An empty table gives an empty result.
    Other columns pass through, whatever their names and values, but those
    named like a result are replaced by it; the text itself is left out.
    """
    require(df, text_col)
    added = ("n_bytes", "n_tokens", "over_limit")
    passed = [c for c in df.columns if c not in added and c != text_col]
    source = numbered(df, passed, text=F.col(quoted(text_col)))
    schema = source.drop("text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        counter = counter_for(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in plain_list(batch, "text")]
            counts = [counter.count(t) for t in texts]
            columns = [
                *batch.columns[: len(passed)],
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema).toDF(*passed, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
