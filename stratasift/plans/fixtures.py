"""Deterministic projections of the test tables onto the engine's model, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.functions import text
from stratasift.operators import lexical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_masks(docs: DataFrame) -> DataFrame:
    """Adds ``role_mask``, ``dept_mask``, ``epoch`` and ``status`` as functions of ``doc_id``."""
    d = F.col("doc_id")

    def mask(m):
        value = F.when(d % m == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, cast(doc_id % 4 as int))"))
        return F.when(d % 97 == 0, F.lit(None)).otherwise(value).cast("long")

    return docs.withColumns(
        {
            "role_mask": mask(5),
            "dept_mask": mask(7),
            "epoch": F.when(d % 3 == 0, "e1").when(d % 3 == 1, "e2"),
            "status": F.when(d % 11 == 0, "archived").otherwise("active"),
        }
    )


MASKED_SQL = """masked AS (SELECT *,
  CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0 ELSE 1::BIGINT << (doc_id % 4) END AS role_mask,
  CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 0 ELSE 1::BIGINT << (doc_id % 4) END AS dept_mask,
  CASE WHEN doc_id % 3 = 0 THEN 'e1' WHEN doc_id % 3 = 1 THEN 'e2' END AS epoch,
  CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status FROM documents)"""


def chunks(docs: DataFrame) -> DataFrame:
    """Character windows of the documents: ``doc_id``, ``chunk_index``, ``chunk``, with other columns kept."""
    return docs.select("*", F.posexplode(text.char_windows(F.col("text"))).alias("chunk_index", "chunk")).drop("text")


CHUNKS_SQL = """chunks AS (SELECT doc_id, lang, source, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS chunk
  FROM documents, unnest(range(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 50) / 450.0) AS BIGINT)) END)) u(i))"""


def source_state(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, stored) states of sources: id, hash, masks, status."""
    base = with_masks(docs).select(
        "doc_id", F.sha2("text", 256).alias("hash"), "role_mask", "dept_mask", "status", F.col("doc_id").alias("n")
    )
    current = base.where("n % 17 <> 0").select("doc_id", "hash", "role_mask", "dept_mask")
    stored = base.where("n % 10 <> 0").select(
        "doc_id",
        F.when(F.col("n") % 13 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"),
        "role_mask",
        "dept_mask",
        "status",
    )
    return current, stored


STATE_SQL = (
    MASKED_SQL
    + """,
current_state AS (SELECT doc_id, sha256(text) AS hash, role_mask, dept_mask FROM masked WHERE doc_id % 17 <> 0),
stored_state AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN sha256(sha256(text) || 'x') ELSE sha256(text) END AS hash,
  role_mask, dept_mask, status FROM masked WHERE doc_id % 10 <> 0)"""
)


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, grade) of documents that contain the benchmark text; short ones are graded 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return lexical.containing(docs, items, "doc_id", "text", "passage").select(
        "item_id", "doc_id", F.when(F.col("n_chars") < 4000, 2).otherwise(1).alias("grade")
    )


GOLD_SQL = """gold AS (SELECT b.item_id, d.doc_id, CASE WHEN d.n_chars < 4000 THEN 2 ELSE 1 END AS grade
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
