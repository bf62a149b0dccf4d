"""An inverted-file vector index: cells around coarse centroids, probed by queries, verified exactly.

Centroids are fitted on a bounded sample of the vectors (``SAMPLE_ROWS``, those
with the smallest hashes of their ids), every vector is assigned to its nearest
centroid, and the table is ordered by cell, so that a search reads the cells
that its queries probe.  Queries and centroids are broadcast, both being
bounded, so a cell that holds a large share of all vectors is spread over as
many tasks as its files have splits and is never shuffled.  Scores are exact;
only which vectors are looked at is approximate, unless all cells are probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.functions import vectors
from stratasift.staging import stage

from .dense import BROADCAST_QUERIES, COSINE, TASK_ROWS, Measure, scored_blocks, similarity_top_k
from .lexical import top_k

#: Vectors that the centroids are fitted on, at most.
SAMPLE_ROWS = 100_000

#: Passes over the sample.
ROUNDS = 10

#: Cells are as many as the root of the number of vectors, up to this.
MAX_CELLS = 4096

#: Pairs of a query and a cell that are broadcast at once, without vectors: 32 MB.
PROBED_PAIRS = 2_000_000

#: Vectors that ask the finished index for their exact neighbours, and the share of these that their cells must hold.
CALIBRATION_QUERIES, NEIGHBOURS, TARGET_RECALL = 200, 10, 0.95


def _units(values: np.ndarray) -> np.ndarray:
    norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return values / np.where(norms > 0, norms, 1.0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return _units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def usable(corpus: DataFrame, dim: int) -> DataFrame:
    """(doc, vector) rows that can be compared: ``dim`` finite components, not all zero."""
    directed = F.when(vectors.valid_vector(F.col("vector"), dim), vectors.norm(F.col("vector")) > 0)
    return corpus.where(F.coalesce(directed, F.lit(False)))


def fit_centroids(corpus: DataFrame, cells: int, dim: int) -> np.ndarray:
    """Centroids of unit vectors, fitted on the bounded sample.

    They start as the first vectors of the sample and move to the means of
    what is nearest to them; a pass over the sample returns one row of sums for
    each task.  A centroid that nothing is nearest to stays.
    """
    session = corpus.sparkSession
    order = (F.xxhash64("doc"), "doc")
    dealt = corpus.orderBy(*order).limit(SAMPLE_ROWS).select("doc", "vector").repartition(session.sparkContext.defaultParallelism)
    sample = stage(dealt, "sample")
    first = sample.orderBy(*order).limit(cells).collect()
    centroids = _units(np.array([r["vector"] for r in first], np.float64).reshape(-1, dim))
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], fixed: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(fixed.shape), np.zeros(len(fixed), np.int64)
            for batch in batches:
                rows = _matrix(batch.column(0), dim)
                nearest = _nearest(fixed, rows, 1)[:, 0]
                np.add.at(sums, nearest, rows)
                counts += np.bincount(nearest, minlength=len(fixed))
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()]), "counts": pa.array([counts.tobytes()])})

        found = sample.select("vector").mapInArrow(run, "sums binary, counts binary").collect()
        sums = sum(np.frombuffer(r["sums"], np.float64).reshape(-1, dim) for r in found)
        counts = sum(np.frombuffer(r["counts"], np.int64) for r in found)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(centroids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row the numbers of its nearest centroids, nearest first."""
    gaps = (centroids * centroids).sum(axis=1) - 2 * rows @ centroids.T
    if n >= len(centroids):
        return np.argsort(gaps, axis=1, kind="stable")
    some = np.argpartition(gaps, n - 1, axis=1)[:, :n]
    order = np.argsort(np.take_along_axis(gaps, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def with_cells(rows: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """Adds ``cell`` and its ``place``; with ``probes``, a row for each of so many nearest cells."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = _nearest(centroids, _matrix(batch.column(batch.schema.get_field_index("vector")), width), probes)
            spread = batch.take(pa.array(np.repeat(np.arange(len(batch)), near.shape[1])))
            place = np.tile(np.arange(near.shape[1]), len(batch))
            added = [pa.array(near.ravel(), pa.int32()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays([*spread.columns, *added], names=[*batch.schema.names, "cell", "place"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, *[T.StructField(c, T.IntegerType()) for c in ("cell", "place")]]))


def with_probes(queries: DataFrame, centroids: np.ndarray, depth: int) -> DataFrame:
    """Adds ``cells``, the numbers of each query's nearest cells."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = _nearest(centroids, _matrix(batch.column(batch.schema.get_field_index("vector")), width), depth)
            offsets = pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32())
            cells = pa.ListArray.from_arrays(offsets, pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return queries.mapInArrow(run, T.StructType([*queries.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


class VectorIndex:
    """An index below one folder of ``corpus(doc, vector, ...)``; other columns are stored beside.

    Vectors with another number of components than ``dim``, with null or
    non-finite ones or of length zero are not indexed; every other row is.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int):
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim

    def build(self, corpus: DataFrame, cells: int | None = None) -> None:
        rows = usable(corpus, self.dim)
        n = rows.count()
        cells = min(n, MAX_CELLS, cells or max(1, round(n**0.5)))
        centroids = fit_centroids(rows, cells, self.dim) if cells > 1 else np.zeros((cells, self.dim))
        table = [(i, c) for i, c in enumerate(centroids.tolist())]
        self.spark.createDataFrame(table, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")
        if len(centroids):
            # A cell with very many vectors is cut by their hashes.
            dealt = with_cells(rows, centroids).drop("place").repartitionByRange("cell", F.xxhash64("doc")).sortWithinPartitions("cell")
        else:
            dealt = rows.withColumn("cell", F.lit(0))
        dealt.write.mode("overwrite").parquet(f"{self.root}/vectors")
        row = self.spark.createDataFrame([(self._calibrated(centroids),)], "probes int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/settings")

    def _calibrated(self, centroids: np.ndarray) -> int:
        """So many cells hold the target share of the exact neighbours of a bounded sample of the vectors."""
        if len(centroids) < 2:
            return 1
        asked = self.rows().orderBy(F.xxhash64("doc", F.lit(1)), "doc").limit(CALIBRATION_QUERIES).select(F.col("doc").alias("query"), "vector")
        exact = similarity_top_k(self.rows(), asked, NEIGHBOURS).select("query", "doc")
        order = with_cells(asked, centroids, len(centroids)).select("query", F.col("cell").alias("probed"), "place")
        homes = exact.join(self.rows().select("doc", "cell"), "doc")
        places = homes.join(F.broadcast(order), (homes["query"] == order["query"]) & (F.col("cell") == F.col("probed")))
        wanted = places.agg(F.percentile("place", TARGET_RECALL)).first()[0]
        return min(len(centroids), int(wanted or 0) + 2)

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows], np.float64).reshape(-1, self.dim)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    def probes(self) -> int:
        """How many cells a query probes unless it says otherwise, as calibrated when the index was built."""
        return self.spark.read.parquet(f"{self.root}/settings").first()["probes"]

    def search(self, queries: DataFrame, k: int, probes: int | None = None, measure: Measure = COSINE, owner: str | None = None, where: Column | None = None) -> DataFrame:
        """(query, doc, score, rank) of the k best among the vectors in each query's cells.

        ``queries(query, vector)`` are a stated set; they are broadcast in
        blocks of at most 20,000, and of fewer if each probes many cells.  The
        vectors of a cell are scored in blocks against the queries that probe
        it.  A query never finds itself.  With ``owner`` the best
        vector of each owner counts; ``where`` filters before the top is taken.
        """
        centroids = self.centroids()
        asked = usable(queries, self.dim).select("query", "vector")
        depth = min(len(centroids), probes or self.probes())
        n = asked.count()
        blocks = max(1, -(-n // BROADCAST_QUERIES), 0 if depth >= len(centroids) else -(-n * depth // PROBED_PAIRS))
        corpus = self.rows() if where is None else self.rows().where(where)
        rows = corpus.select("cell", "doc", F.col(owner or "doc").alias("owner"), F.col("vector").alias("v"))
        tasks = max(1, min(self.spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)))
        # A block has vectors of few cells, and a cell with very many is in many blocks.
        dealt = rows.repartitionByRange(tasks, "cell", F.xxhash64("doc")).sortWithinPartitions("cell")
        every = depth >= len(centroids)
        parts = []
        for b in range(blocks):
            some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
            if every:
                scored = scored_blocks(dealt.drop("cell"), some.withColumnRenamed("vector", "v"), k, measure, owner is not None)
            else:
                scored = scored_blocks(dealt, with_probes(some, centroids, depth).withColumnRenamed("vector", "v"), k, measure, owner is not None)
            parts.append(top_k(scored, k))
        return reduce(DataFrame.unionByName, parts)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, n_exact, n_found, recall): how many of the exact results are among those found."""
    both = exact.select("query", "doc").join(found.select("query", "doc", F.lit(1).alias("hit")), ["query", "doc"], "left")
    return both.groupBy("query").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))
