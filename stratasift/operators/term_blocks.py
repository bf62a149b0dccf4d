"""Documents as packed blocks of term counts, and the best of them for all queries by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .block_search import Best, rounded

#: Stand for terms: the end of a document, and in statistics all documents and all their words.
END, LENGTH = -1, -2

#: Documents in a block, queries that are scored at once, and numbers of a matrix of term weights.
BLOCK_DOCS, CHUNK_QUERIES, MATRIX = 1024, 256, 4_000_000

FIELDS = "shown binary, dl binary, ends binary, nos binary, tfs binary"

#: Of blocks with pairs that don't count: the document's place and the query of each.
BARRED_FIELDS = FIELDS + ", barred_at binary, barred array<{query}>"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc, shown, dl, no): a document's rows follow each other, and its last has the number END.

    A fifth column ``barred`` has the queries that must not find the document.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += int(np.count_nonzero(batch.column("no").to_numpy() == END))
        if n >= BLOCK_DOCS:
            whole = pa.Table.from_batches(held).combine_chunks()
            ends = np.flatnonzero(whole["no"].to_numpy() == END)
            yield _block(whole.slice(0, ends[-1] + 1))
            held, n = whole.slice(ends[-1] + 1).to_batches(), 0
    if held and n:
        yield _block(pa.Table.from_batches(held).combine_chunks())


def _block(rows: pa.Table) -> pa.RecordBatch:
    nos = rows["no"].to_numpy().astype(np.int64)
    last = nos == END
    place = np.cumsum(last) - last
    width = int(nos.max()) + 1 if len(nos) else 1
    keys, tfs = np.unique(place[~last] * max(1, width) + nos[~last], return_counts=True)
    at = np.flatnonzero(last)
    own = np.searchsorted(keys // max(1, width), np.arange(len(at)), "right")
    marked = rows.take(pa.array(at)).combine_chunks()
    numbers = [marked["shown"].to_numpy().astype(np.int8), marked["dl"].to_numpy().astype(np.int32), own.astype(np.int64), (keys % max(1, width)).astype(np.int32), tfs.astype(np.int32)]
    docs = marked["doc"].combine_chunks()
    docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
    columns = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), docs)]
    names = ["docs", "shown", "dl", "ends", "nos", "tfs"]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in numbers]
    if "barred" in marked.column_names:
        lists = pa.concat_arrays(marked["barred"].chunks)
        flat = pc.list_flatten(lists)
        columns += [pa.array([pc.list_parent_indices(lists).to_numpy().astype(np.int32).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
        names += ["barred_at", "barred"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, n): how many documents have each term, of each block; END for all documents and LENGTH for their words."""
    for batch in batches:
        for docs, dl, nos in zip(batch.column("docs"), batch.column("dl"), batch.column("nos"), strict=True):
            number, n = np.unique(np.frombuffer(nos.as_py(), np.int32), return_counts=True)
            words = int(np.frombuffer(dl.as_py(), np.int32).sum(dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"no": pa.array(np.r_[number, END, LENGTH], pa.int32()), "n": pa.array(np.r_[n, len(docs.values), words], pa.int64())})


def _chunks(weights: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, terms, weights of terms by queries) of each chunk of queries."""
    out = []
    for at in range(0, len(weights), CHUNK_QUERIES):
        some = weights.slice(at, CHUNK_QUERIES)
        flat = some.flatten()
        query = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
        terms, term = np.unique(flat.field("no").to_numpy(), return_inverse=True)
        table = np.zeros((len(terms), len(some)))
        table[term, query] = flat.field("idf").to_numpy()
        out.append((np.arange(at, at + len(some)), terms, table))
    return out


def best(batches: Iterator[pa.RecordBatch], k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(query, doc, score) of the ``k`` best documents of each query in all batches."""
    chunks = queries = None
    found: list[Best] = []
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
            if chunks is None:
                queries, chunks = row["queries"].values, _chunks(row["weights"].values)
                found = [Best(len(own), k, row["docs"].values.type) for own, _, _ in chunks]
                numbers = {q: i for i, q in enumerate(queries.to_pylist())} if "barred" in row else {}
            shown, dl, ends, nos, tfs = (np.frombuffer(row[c].as_py(), kind) for c, kind in (("shown", np.int8), ("dl", np.int32), ("ends", np.int64), ("nos", np.int32), ("tfs", np.int32)))
            docs, average = row["docs"].values, row["avgdl"].as_py()
            if not len(nos):
                continue
            barred_at = np.frombuffer(row["barred_at"].as_py(), np.int32) if numbers else np.zeros(0, np.int32)
            # Queries without a word that a document has are not among the numbers.
            barred = np.array([numbers.get(q, -1) for q in row["barred"].as_py()] if numbers else [], np.int64)
            own = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            part = tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * dl[own] / average))
            for (asking, terms, table), best_of in zip(chunks, found, strict=True):
                column = np.minimum(np.searchsorted(terms, nos), len(terms) - 1)
                used = terms[column] == nos
                step = max(1, MATRIX // len(terms))
                for at in range(0, len(ends), step):
                    here = used & (own >= at) & (own < at + step)
                    counts = np.zeros((min(step, len(ends) - at), len(terms)))
                    counts[own[here] - at, column[here]] = part[here]
                    scores = np.ascontiguousarray((counts @ table).T)
                    scores[(scores <= 0) | (shown[at : at + step] == 0)[None, :]] = -np.inf
                    out = (barred >= asking[0]) & (barred <= asking[-1]) & (barred_at >= at) & (barred_at < at + step)
                    scores[barred[out] - asking[0], barred_at[out] - at] = -np.inf
                    q, d = best_of.candidates(scores, np.arange(len(scores)), 2e-6)
                    if len(q):
                        best_of.add(q, rounded(scores[q, d]), docs.take(pa.array(d + at)))
    for (own, _, _), best_of in zip(chunks or [], found, strict=True):
        table = best_of.settle()
        asked = queries.take(pa.array(own[table["q"].to_numpy()]))
        out = pa.table({"query": asked, "doc": table["i"], "score": table["s"]})
        yield from out.combine_chunks().to_batches()
