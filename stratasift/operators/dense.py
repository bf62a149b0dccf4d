"""Dense retrieval: exact inner-product search, reranking and centroids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.functions import vectors

from . import block_search
from .block_search import BLOCK_FIELDS, NAN_SCORE, NULL_SCORE, SLACK, Best, Measure
from .lexical import top_k

#: Query vectors up to this number are broadcast to the corpus scan; more are taken in blocks.
BROADCAST_QUERIES = 20_000

#: Vectors in a block of queries and of the corpus: the matrix of their scores has 32 MB.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 4096

#: Rows of a corpus for one task, at least.
TASK_ROWS = 512

COSINE = Measure()


def similarity_top_k(corpus: DataFrame, queries: DataFrame, k: int, measure: Measure = COSINE, owner: str | None = None) -> DataFrame:
    """(query, doc, score, rank) with ``corpus(doc, vector)`` and ``queries(query, vector)``.

    A stated set of queries meets every row of the corpus, in blocks that are
    small enough to broadcast.  Each task scores blocks of its rows against all
    blocks of queries and keeps ``k`` per query before anything is shuffled.
    With ``owner``, a column of the corpus, the best vector of each owner
    counts and owners are ranked.
    """
    rows = corpus.select("doc", F.col(owner or "doc").alias("owner"), F.col("vector").alias("v"))
    tasks = corpus.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(max(1, min(tasks, -(-rows.count() // TASK_ROWS))))
    asked = queries.select("query", F.col("vector").alias("v"))
    n = asked.count()
    blocks = max(1, -(-n // BROADCAST_QUERIES))
    parts = []
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        parts.append(top_k(scored_blocks(dealt, some, k, measure, owner is not None), k))
    return reduce(DataFrame.unionByName, parts)


def _packed(rows: DataFrame, ids: list[str], size: int) -> DataFrame:
    fields = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ids]
    schema = T.StructType([*fields, *T.StructType.fromDDL(BLOCK_FIELDS).fields])
    return rows.select(*ids, "v").mapInArrow(lambda batches: block_search.packed(batches, ids, size), schema)


def scored_blocks(rows: DataFrame, asked: DataFrame, k: int, measure: Measure, owners: bool = False) -> DataFrame:
    """(query, doc, score): the ``k`` best of each of ``asked(query, v)`` in each partition of ``rows(doc, owner, v)``.

    If rows have a ``cell`` and queries an array ``cells``, they meet in these
    only.  A query never meets itself, nor a row without an id.
    """
    cells = "cell" in rows.columns
    own = ["doc", "owner", *(["cell"] if cells else [])]
    near = _packed(asked.where(F.col("query").isNotNull()).repartition(1), ["query", *(["cells"] if cells else [])], QUERY_BLOCK)
    near = near.select(F.monotonically_increasing_id().alias("block"), *[F.col(c).alias(f"q_{c}") for c in near.columns])
    blocks = _packed(rows.where(F.col("doc").isNotNull()), own, CORPUS_BLOCK).crossJoin(F.broadcast(near))
    item, asker = rows.schema["owner"].dataType, asked.schema["query"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[pa.Array, Best]] = {}
        askers: dict[int, _Side] = {}
        for batch in batches:
            names = batch.schema.names
            for i in range(len(batch)):
                row = {c: batch.column(j)[i] for j, c in enumerate(names)}
                number = row["block"].as_py()
                if number not in found:
                    askers[number] = _Side(row, "q_", "query", "q_cells" if cells else None)
                    found[number] = (askers[number].ids, Best(len(askers[number].ids), k, row["owner"].values.type, owners))
                _meet(askers[number], _Side(row, "", "doc", "cell" if cells else None), row["owner"].values, found[number][1], measure, owners)
        for ids, best in found.values():
            table = best.settle()
            score = table["s"].to_numpy()
            value = pa.array(np.where(score == NAN_SCORE, np.nan, score), mask=score == NULL_SCORE)
            out = pa.table({"query": ids.take(table["q"].combine_chunks()), "doc": table["i"], "score": value})
            yield from out.combine_chunks().to_batches()

    schema = T.StructType([T.StructField("query", asker), T.StructField("doc", item), T.StructField("score", T.DoubleType())])
    found = blocks.mapInArrow(run, schema)
    return found.groupBy("query", "doc").agg(F.max("score").alias("score")) if owners else found


class _Side:
    """One packed block."""

    def __init__(self, row: dict, prefix: str, name: str, cells: str | None):
        self.ids = row[prefix + name].values
        self.width = row[prefix + "width"].as_py()
        self.rows = block_search.matrix(self.width, row[prefix + "vectors"].as_py(), len(self.ids))
        self.lengths = block_search.lengths(self.rows)
        self.members: dict[int, np.ndarray] = {}
        if cells:
            values = row[cells].values
            if pa.types.is_list(values.type):
                flat, own = values.flatten().to_numpy(), np.repeat(np.arange(len(values)), np.diff(values.offsets.to_numpy()))
            else:
                flat, own = values.to_numpy(), np.arange(len(values))
            order = np.argsort(flat, kind="stable")
            numbers, begins = np.unique(flat[order], return_index=True)
            self.members = dict(zip(numbers.tolist(), np.split(own[order], begins[1:]), strict=True))


def _meet(a: _Side, b: _Side, owners: pa.Array, best: Best, measure: Measure, merge: bool) -> None:
    every_a, every_b = np.arange(len(a.ids)), np.arange(len(b.ids))
    same_q, same_d = block_search.same_items(a.ids, b.ids)
    if not b.members:
        groups = [(every_a, every_b)]
    else:
        groups = [(a.members[c], columns) for c, columns in b.members.items() if c in a.members]
    code = owners.dictionary_encode() if merge else None
    for queries, columns in groups:
        comparable = a.width == b.width and a.width >= 0
        if not comparable:
            near = measure.missing((len(queries), len(columns)))
        else:
            near = measure.near(a.rows[queries], a.lengths[queries], b.rows[columns], b.lengths[columns])
        if len(same_q):
            row_of, column_of = np.full(len(a.ids), -1), np.full(len(b.ids), -1)
            row_of[queries], column_of[columns] = np.arange(len(queries)), np.arange(len(columns))
            here = (row_of[same_q] >= 0) & (column_of[same_d] >= 0)
            near[row_of[same_q[here]], column_of[same_d[here]]] = -np.inf
        if not merge:
            q, d = best.candidates(near, queries, SLACK)
        else:
            # Each owner's best first; then its vectors that may have that score.
            own = code.indices.to_numpy()[columns]
            order = np.argsort(own, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
            tops = np.maximum.reduceat(near[:, order], begins, axis=1)
            q, o = best.candidates(tops, queries, SLACK)
            hopeful = np.full(tops.shape, np.inf)
            hopeful[q, o] = tops[q, o] - SLACK
            group = np.empty(len(columns), np.int64)
            group[order] = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(order)]))
            # NaN counts as infinite, and so does the bound of what is no candidate.
            wanted = np.zeros(tops.shape, bool)
            wanted[q, o] = True
            q, d = np.nonzero((near >= hopeful[:, group]) & wanted[:, group] & (near > -np.inf))
        if not len(q):
            continue
        at, of = queries[q], columns[d]
        scores = near[q, d]
        if comparable:
            scores = measure.exact(a.rows[at], a.lengths[at], b.rows[of], b.lengths[of])
        best.add(at, scores, owners.take(pa.array(of)))


def centroid(rows: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Mean direction of the vectors of each group, scaled to length one."""
    spread = rows.select(*(by or []), F.posexplode(vector).alias("i", "x"))
    means = spread.groupBy(*(by or []), "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    grouped = means.groupBy(*(by or [])).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean")
    )
    return grouped.withColumn("centroid", vectors.l2_normalize(F.col("mean"))).drop("mean")
