"""Centroid clustering of integer vectors with Elkan's bounds.

Vectors are packed in blocks, and each block keeps, from round to round, an
upper bound on every vector's distance to its centroid and a lower bound on
that to each of the k centroids.  After the centroids have moved the bounds
move with them, and with the distances between centroids they tell which
vectors cannot change and which centroids need not be looked at.  Upper bounds
are rounded up and lower bounds down, and only strictly larger lower bounds
rule a centroid out, so ties are always decided by exact integer distances.

A round is one pass over the blocks, written to the shared folder; of it only
k sums, counts and centroids meet, so nothing that grows with the vectors is
shuffled or collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees_memory, quoted, read_table, remove_folder, require, stage_at

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256

#: Seeds are the vectors with the smallest digests of this and their id.
SEED_PREFIX = "2:"

#: Vectors in one block: with 64 components and 40 bounds each, 2 MB.
BLOCK_VECTORS = 4096

#: Larger integers could give squared distances that no 64-bit integer holds.
LARGEST = 1 << 27

#: Relative room for the rounding of one operation on bounds.
_ROOM = 2.0**-50
_ROOM32 = np.float32(2.0**-22)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _ROOM)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - _ROOM)


def _down32(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not larger; the bounds are kept so."""
    return np.maximum(x.astype(np.float32) * (np.float32(1) - _ROOM32), np.float32(0))


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances; differences of integers up to LARGEST fit in 64 bits."""
    gap = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Elkan:
    """The bounds' rules for one set of centroids; ``moved`` are the distances that they have moved, rounded up."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        pairs = np.stack([squared(centroids, c) for c in centroids]) if k else np.zeros((0, 0), np.int64)
        self.half = _down(np.sqrt(pairs.astype(np.float64))) / 2
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1) if k else np.zeros(0)
        self.moved = None if before is None else _up(np.sqrt(np.array([squared(a[None], b)[0] for a, b in zip(centroids, before, strict=True)], np.float64)))

    def carried(self, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds after the move."""
        return _up(upper + self.moved[assigned]), _down32(_down(lower.astype(np.float64) - self.moved))

    def assign(self, vectors: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings ``assigned`` and the bounds up to date; returns how many distances it took.

        Of equally near centroids the one with the smaller number wins.
        """
        open_rows = np.flatnonzero(upper >= self.nearest[assigned])
        if not len(open_rows):
            return 0
        taken = len(open_rows)
        own = assigned[open_rows]
        best = _rows_to(vectors[open_rows], self.centroids[own])
        bound = _up(np.sqrt(best.astype(np.float64)))
        lower[open_rows, own] = _down32(_down(np.sqrt(best.astype(np.float64))))
        for j in range(len(self.centroids)):
            near = np.flatnonzero((own != j) & (lower[open_rows, j] <= bound) & (self.half[own, j] <= bound))
            if not len(near):
                continue
            taken += len(near)
            rows = open_rows[near]
            exact = squared(vectors[rows], self.centroids[j])
            root = np.sqrt(exact.astype(np.float64))
            lower[rows, j] = _down32(_down(root))
            wins = (exact < best[near]) | ((exact == best[near]) & (j < own[near]))
            won = near[wins]
            own[won], best[won], bound[won] = j, exact[wins], _up(root[wins])
        assigned[open_rows], upper[open_rows] = own, bound
        return taken


def _rows_to(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    gap = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", gap, gap)


def quantised(df: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(id, q): the vectors that can be clustered, as integers."""
    vector = F.transform(F.col(quoted(vector_col)), lambda x: x.cast("double"))
    scaled = F.transform("v", lambda x: F.floor(x * scale))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale))
    rows = df.select(F.col(quoted(id_col)).alias("id"), vector.alias("v"))
    return rows.where((F.size("v") == components) & finite).select("id", scaled.cast("array<int>").alias("q"))


def _seeds(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The first centroids, at most k rows."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _block_fields(id_type: T.DataType) -> T.StructType:
    """A block: ids, then vectors, clusters and bounds as packed numbers; sums and counts of its clusters beside them."""
    binary = ("vectors", "clusters", "upper", "lower", "sums", "squares")
    return T.StructType([T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(c, T.BinaryType()) for c in binary], T.StructField("taken", T.LongType())])


def _packed(ids: pa.Array, vectors, clusters, upper, lower, elkan: Elkan, taken: int) -> pa.RecordBatch:
    k, d = elkan.centroids.shape
    total = np.zeros((k, d + 1), np.int64)
    np.add.at(total[:, 0], clusters, 1)
    for j in np.flatnonzero(total[:, 0]).tolist():
        total[j, 1:] = vectors[clusters == j].sum(axis=0, dtype=np.int64)
    squares = _rows_to(vectors, elkan.centroids[clusters])
    list_of_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (vectors, clusters, upper, lower, total, squares)]
    return pa.RecordBatch.from_arrays(
        [list_of_ids, *binary, pa.array([taken], pa.int64())],
        names=["ids", "vectors", "clusters", "upper", "lower", "sums", "squares", "taken"],
    )


def first_blocks(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of vectors, assigned to the first centroids."""
    k, d = centroids.shape
    elkan = Elkan(centroids, None)

    def block(rows: pa.Table) -> pa.RecordBatch:
        q = _matrix(rows.column("q").combine_chunks(), d).astype(np.int32)
        clusters = np.zeros(len(q), np.int32)
        upper, lower = np.full(len(q), np.inf), np.zeros((len(q), k), np.float32)
        taken = elkan.assign(q, clusters, upper, lower)
        return _packed(rows.column("id").combine_chunks(), q, clusters, upper, lower, elkan, taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            while sum(map(len, rest)) >= BLOCK_VECTORS:
                rows = pa.Table.from_batches(rest)
                yield block(rows.slice(0, BLOCK_VECTORS))
                rest = rows.slice(BLOCK_VECTORS).to_batches()
        if sum(map(len, rest)):
            yield block(pa.Table.from_batches(rest))

    return vectors.mapInArrow(frees_memory(run), _block_fields(vectors.schema["id"].dataType))


def next_blocks(blocks: DataFrame, centroids: np.ndarray, before: np.ndarray) -> DataFrame:
    """The blocks after the centroids have moved from ``before``."""
    k, d = centroids.shape
    elkan = Elkan(centroids, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                raw = {c: batch.column(c)[i].as_py() for c in ("vectors", "clusters", "upper", "lower")}
                q = np.frombuffer(raw["vectors"], np.int32).reshape(-1, d)
                clusters = np.frombuffer(raw["clusters"], np.int32).copy()
                upper = np.frombuffer(raw["upper"], np.float64)
                lower = np.frombuffer(raw["lower"], np.float32).reshape(-1, k)
                upper, lower = elkan.carried(clusters, upper, lower)
                taken = elkan.assign(q, clusters, upper, lower)
                yield _packed(batch.column("ids")[i].values, q, clusters, upper, lower, elkan, taken)

    return blocks.mapInArrow(frees_memory(run), blocks.schema)


def cluster_sums(blocks: DataFrame, k: int, d: int) -> list[list[int]]:
    """For each cluster its count and component sums, exactly; k rows from each task meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), object)
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                total += np.frombuffer(raw, np.int64).reshape(k, d + 1)
        texts = [" ".join(map(str, row)) for row in total.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(texts)], names=["cluster", "sums"])

    # As text, since sums over very many blocks may not fit in 64 bits.
    rows = blocks.select("sums").mapInArrow(run, "cluster int, sums string").withColumn("s", F.split("sums", " "))
    exact = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d + 1)]
    found = {r["cluster"]: [int(r[f"s{i}"]) for i in range(d + 1)] for r in rows.groupBy("cluster").agg(*exact).collect()}
    return [found.get(j, [0] * (d + 1)) for j in range(k)]


def moved_centroids(centroids: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters stay."""
    return np.array([[s // n for s in row] if n else old.tolist() for (n, *row), old in zip(sums, centroids, strict=True)], np.int64)


def elkan_clusters(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed_prefix: str = SEED_PREFIX,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((id, cluster, distance) of each vector, final centroids, distances taken in each round).

    Components become the integers ``floor(scale * x)``; distances are exact
    squared Euclidean distances of integers.  The first centroids are the k
    vectors with the smallest digests of ``seed_prefix`` and their id (fewer if
    there are fewer vectors; of one id, by their components).  Each round
    assigns every vector to its nearest centroid, of several to the one with
    the smallest number, and moves non-empty centroids to the floor of their
    mean; at last all vectors are assigned once more.

    Vectors that are null, have another number of components, a null or a
    non-finite one are left out, and so are those with a component beyond
    2**27 once scaled, whose distances no 64-bit integer holds.  Repeated rows
    are vectors of their own, null ids are ids (with an empty text for the
    digest).  An empty table gives an empty result and no centroids.  Other
    columns are not looked at, whatever their names.
    """
    require(df, id_col, vector_col)
    spark = df.sparkSession
    vectors = quantised(df, id_col, vector_col, components, scale)
    centroids = _seeds(vectors, k, seed_prefix).reshape(-1, components)
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return spark.createDataFrame([], out), centroids, []
    blocks, path = stage_at(first_blocks(vectors, centroids), "clusters")
    for _ in range(rounds):
        before, centroids = centroids, moved_centroids(centroids, cluster_sums(blocks, len(centroids), components))
        done = path
        blocks, path = stage_at(next_blocks(blocks, centroids, before), "clusters")
        remove_folder(spark, done)
    taken = blocks.agg(F.sum("taken")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                clusters = np.frombuffer(batch.column("clusters")[i].as_py(), np.int32)
                squares = np.frombuffer(batch.column("squares")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(clusters), pa.array(squares)], names=["id", "cluster", "distance"])

    return blocks.select("ids", "clusters", "squares").mapInArrow(run, out), centroids, taken


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = elkan_clusters(read_table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    # A row for each centroid.
    table = spark.createDataFrame(
        [(j, sums.get(j, 0), sum(sums.values()), digests[j]) for j in range(len(digests))],
        "of int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(table), F.col("cluster") == F.col("of")).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql_round(i: int) -> str:
    """a{i}: nearest centroids; c{i + 1}: the moved ones."""
    return f"""
t{i} AS MATERIALIZED (SELECT vec_id, j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d2 FROM v JOIN c{i} c USING (p) GROUP BY vec_id, j),
a{i} AS MATERIALIZED (SELECT vec_id, j, d2 FROM t{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, j) = 1),
m{i} AS (SELECT j, p, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (vec_id) GROUP BY j, p),
c{i + 1} AS MATERIALIZED (
  SELECT c.j, c.p, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM c{i} c LEFT JOIN m{i} USING (j, p)),"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {COMPONENTS}),
v AS MATERIALIZED (SELECT vec_id, p, CAST(floor({SCALE} * e[p]) AS BIGINT) AS x FROM kept, unnest(range(1, {COMPONENTS + 1})) u(p)),
seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED_PREFIX}' || CAST(vec_id AS VARCHAR))) - 1 AS j FROM kept QUALIFY j < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS j, p, x FROM v JOIN seeds USING (vec_id)),
{"".join(_sql_round(i) for i in range(ROUNDS))}
tl AS MATERIALIZED (SELECT vec_id, j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d2 FROM v JOIN c{ROUNDS} c USING (p) GROUP BY vec_id, j),
al AS MATERIALIZED (SELECT vec_id, j, d2 FROM tl QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, j) = 1),
h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
SELECT vec_id, j AS cluster, d2 AS distance, CAST(sum(d2) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d2) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM al JOIN h USING (j)
"""
