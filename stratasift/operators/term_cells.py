"""Postings of cells of documents: made from analysed documents, bounded and scored by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .block_search import Best, rounded
from .term_blocks import CHUNK_QUERIES, MATRIX

#: Words that are inverted at once at most; a part that has more gives several rows of a term.
MOST_WORDS = 12_000_000

#: Rows of a batch that leaves Python.
BATCH = 20_000

#: Stand for terms: documents that are hidden, documents that may be found, queries that ask a cell.
HIDDEN, VISIBLE, ASKED = -1, -2, -3


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, part, cells, max_tf, min_dl, ends, n_words, docs, tfs, dls) of (doc, part, cell, dl, words): the cells' entries follow each other, and ``ends`` says where each cell's end."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(pc.list_flatten(batch.column("words")))
        if n > MOST_WORDS:
            yield from _inverted(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _inverted(pa.Table.from_batches(held))


def _lists(offsets: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _inverted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.take(pc.sort_indices(rows, [("part", "ascending"), ("cell", "ascending"), ("doc", "ascending")]))
    part, cell, dl = (rows[c].to_numpy() for c in ("part", "cell", "dl"))
    lists = _one(rows["words"])
    words = pc.list_flatten(lists).dictionary_encode()
    keys = words.indices.to_numpy().astype(np.int64) * len(rows) + pc.list_parent_indices(lists).to_numpy()
    keys, tf = np.unique(keys, return_counts=True)
    term, row = keys // len(rows), keys % len(rows)
    new_row = np.r_[True, (term[1:] != term[:-1]) | (part[row][1:] != part[row][:-1])]
    starts = np.flatnonzero(new_row | np.r_[True, cell[row][1:] != cell[row][:-1]])
    firsts = np.flatnonzero(new_row)
    of_run = np.searchsorted(firsts, starts, "right") - 1
    runs, entries = np.r_[np.searchsorted(starts, firsts), len(starts)], np.r_[firsts, len(keys)]
    out = pa.table(
        {
            "term": words.dictionary.take(pa.array(term[firsts])),
            "part": pa.array(part[row[firsts]], pa.int64()),
            "cells": _lists(runs, cell[row[starts]].astype(np.int64)),
            "max_tf": _lists(runs, np.maximum.reduceat(tf, starts).astype(np.int32)),
            "min_dl": _lists(runs, np.minimum.reduceat(dl[row], starts).astype(np.int32)),
            "ends": _lists(runs, (np.r_[starts[1:], len(keys)] - firsts[of_run]).astype(np.int32)),
            "n_words": pa.array(np.add.reduceat(tf, firsts), pa.int64()),
            "docs": _lists(entries, _one(rows["doc"]).take(pa.array(row))),
            "tfs": _lists(entries, tf.astype(np.int32)),
            "dls": _lists(entries, dl[row].astype(np.int32)),
        }
    )
    yield from out.to_batches(max_chunksize=BATCH)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each (commit, part), which follow each other."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        commit, part = batch.column("commit").to_numpy(), batch.column("part").to_numpy()
        edges = np.flatnonzero(np.r_[True, (commit[1:] != commit[:-1]) | (part[1:] != part[:-1])])
        for at, end in zip(edges, np.r_[edges[1:], len(batch)], strict=True):
            if held and (commit[at], part[at]) != now:
                yield int(now[0]), pa.Table.from_batches(held)
                held = []
            now = (commit[at], part[at])
            held.append(batch.slice(at, end - at))
    if held:
        yield int(now[0]), pa.Table.from_batches(held)


class Weights:
    """(query, no, idf) of all queries, in the order of their numbers: terms of a query follow each other."""

    def __init__(self, rows: pa.Table):
        coded = _one(rows["query"]).dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        self.queries = coded.dictionary
        self.query = coded.indices.to_numpy()[order]
        self.no, self.idf = rows["no"].to_numpy()[order], rows["idf"].to_numpy()[order]
        self.begins = np.searchsorted(self.query, np.arange(len(self.queries) + 1))
        self.terms = int(self.no.max()) + 1 if len(self.no) else 0

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``queries``, term, weight) of some queries."""
        n = self.begins[queries + 1] - self.begins[queries]
        place = np.repeat(np.arange(len(queries)), n)
        at = np.repeat(self.begins[queries], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.no[at], self.idf[at]


def _gain(tf: np.ndarray, dl: np.ndarray, average: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))


def bounds(batches: Iterator[pa.RecordBatch], w: Weights, average: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(query, commit, part, cell, bound): what a document of a cell can score at most, for cells that share a term with a query."""
    for commit, rows in _parts(batches):
        lists = _one(rows["cells"])
        no = rows["no"].to_numpy()[pc.list_parent_indices(lists).to_numpy()]
        gain = _gain(*(pc.list_flatten(_one(rows[c])).to_numpy() for c in ("max_tf", "min_dl")), average, k1, b)
        cells, cell = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
        order = np.argsort(cell, kind="stable")
        ends = np.searchsorted(cell[order], np.arange(len(cells)), "right")
        found = []
        for i, end in enumerate(ends):
            own = order[ends[i - 1] if i else 0 : end]
            most = np.bincount(no[own], gain[own], w.terms)
            bound = np.bincount(w.query, w.idf * most[w.no], len(w.queries))
            q = np.flatnonzero(np.bincount(w.query, most[w.no] > 0, len(w.queries)))
            found.append((q, np.full(len(q), cells[i]), bound[q]))
        query, cell, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        part = int(rows["part"][0].as_py())
        out = pa.table({"query": w.queries.take(pa.array(query)), "commit": pa.array(np.full(len(query), commit), pa.int32()), "part": pa.array(np.full(len(query), part), pa.int64()), "cell": pa.array(cell, pa.int64()), "bound": bound})
        yield from out.to_batches(max_chunksize=BATCH)


def best(batches: Iterator[pa.RecordBatch], w: Weights, average: float, k: int, k1: float, b: float, only_visible: bool) -> Iterator[pa.RecordBatch]:
    """(query, doc, score): the ``k`` best documents of each query in the cells that it asks, over all batches.

    Besides postings a part has rows of its hidden (and visible) documents, and
    a row (ASKED, cells, asked) for each cell with the queries that ask it.
    """
    kept = None
    numbers = None
    for _, rows in _parts(batches):
        no = rows["no"].to_numpy()
        if kept is None:
            kept = Best(len(w.queries), k, rows.schema.field("docs").type.value_type)
            numbers = {q: i for i, q in enumerate(w.queries.to_pylist())}
        asked = {r["cells"][0]: np.sort(np.array([numbers[q] for q in r["asked"]])) for r in rows.filter(pa.array(no == ASKED)).select(["cells", "asked"]).to_pylist()}
        if not asked:
            continue
        posted = rows.filter(pa.array(no >= 0))
        if not len(posted):
            continue
        lists, ends = _one(posted["cells"]), _one(posted["ends"])
        of_run = pc.list_parent_indices(lists).to_numpy()
        cell = pc.list_flatten(lists).to_numpy()
        docs = _one(posted["docs"])
        base = np.cumsum(np.r_[0, pc.list_value_length(docs).to_numpy()])
        end = pc.list_flatten(ends).to_numpy() + base[of_run]
        size = np.diff(np.r_[0, end])
        # Entries of all rows follow each other, so a run begins where the one before it ends.
        entry_cell, entry_no = np.repeat(cell, size), np.repeat(posted["no"].to_numpy()[of_run], size)
        coded = pc.list_flatten(docs).dictionary_encode()
        entry_doc, ids = coded.indices.to_numpy(), coded.dictionary
        part = _gain(*(pc.list_flatten(_one(posted[c])).to_numpy() for c in ("tfs", "dls")), average, k1, b)
        barred = pc.is_in(ids, value_set=pc.list_flatten(_one(rows.filter(pa.array(no == HIDDEN))["docs"])))
        if only_visible:
            barred = pc.or_(barred, pc.invert(pc.is_in(ids, value_set=pc.list_flatten(_one(rows.filter(pa.array(no == VISIBLE))["docs"])))))
        barred = barred.to_numpy(zero_copy_only=False)
        order = np.argsort(entry_cell, kind="stable")
        sorted_cells = entry_cell[order]
        for c, queries in asked.items():
            own = order[np.searchsorted(sorted_cells, c, "left") : np.searchsorted(sorted_cells, c, "right")]
            own = own[~barred[entry_doc[own]]]
            doc, row = np.unique(entry_doc[own], return_inverse=True)
            for at in range(0, len(queries) if len(own) else 0, CHUNK_QUERIES):
                some = queries[at : at + CHUNK_QUERIES]
                place, term, idf = w.of(some)
                terms, column = np.unique(term, return_inverse=True)
                table = np.zeros((len(terms), len(some)))
                table[column, place] = idf
                spot = np.minimum(np.searchsorted(terms, entry_no[own]), len(terms) - 1)
                used = terms[spot] == entry_no[own]
                step = max(1, MATRIX // len(terms))
                for d in range(0, len(doc), step):
                    here = used & (row >= d) & (row < d + step)
                    counts = np.zeros((min(step, len(doc) - d), len(terms)))
                    counts[row[here] - d, spot[here]] = part[own[here]]
                    scores = np.ascontiguousarray((counts @ table).T)
                    scores[scores <= 0] = -np.inf
                    q, x = kept.candidates(scores, some, 2e-6)
                    if len(q):
                        kept.add(some[q], rounded(scores[q, x]), ids.take(pa.array(doc[x + d])))
    if kept is not None:
        table = kept.settle()
        out = pa.table({"query": w.queries.take(table["q"].combine_chunks()), "doc": table["i"], "score": table["s"]})
        yield from out.combine_chunks().to_batches()
