"""Queries over the verification of an index's sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.operators import approval

from .catalog import register
from .fixtures import table

_SQL = """ch AS (SELECT doc_id, doc_id || ':' || i AS chunk_id, CASE WHEN doc_id % 50 <> 0 THEN doc_id // 2 END AS source, CASE WHEN doc_id % 23 = 0 THEN 'e0' ELSE 'e1' END AS epoch,
  CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 4 <> 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END END AS status, CASE WHEN doc_id % 31 <> 0 THEN 'someone' END AS actor,
  sha256(CAST(doc_id // 2 AS VARCHAR)) AS h, CASE WHEN doc_id % 37 = 0 THEN 'other' ELSE sha256(CAST(doc_id // 2 AS VARCHAR)) END AS approved_h,
  CASE WHEN doc_id % 3 = 0 THEN 'APPROVED_EXTERNAL' ELSE 'UNTRUSTED' END AS trust FROM documents, range(0, 2) t(i)),
pc AS (SELECT *, list_filter([CASE WHEN source IS NULL THEN 'missing_source_id' END, CASE WHEN status IS NULL THEN 'missing_approval_status' END,
  CASE WHEN status = 'APPROVED' AND actor IS NULL THEN 'approved_without_actor' END, CASE WHEN status = 'APPROVED' AND approved_h <> h THEN 'approved_other_content' END,
  CASE WHEN trust = 'APPROVED_EXTERNAL' AND status <> 'APPROVED' THEN 'trusted_without_approval' END, CASE WHEN epoch <> 'e1' THEN 'other_epoch' END], lambda x: x IS NOT NULL) AS codes FROM ch),
so AS (SELECT source, count(*) AS n_chunks, flatten(list(codes)) AS own FROM pc GROUP BY source),
vd AS (SELECT source, n_chunks, list_sort(list_distinct(list_concat(own, list_filter([CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN source IS NULL THEN 'hash_varies_within_source' END,
  CASE WHEN source IS NULL OR source % 13 = 0 THEN 'not_in_ledger' END, CASE WHEN source % 13 <> 0 AND source % 11 = 0 THEN 'not_approved_in_ledger' END, CASE WHEN source % 13 <> 0 AND source % 17 = 0 THEN 'ledger_hash_differs' END,
  CASE WHEN source IS NULL OR source % 19 = 0 THEN 'source_file_missing' END, CASE WHEN source % 19 <> 0 AND source % 29 = 0 THEN 'file_hash_differs' END], lambda x: x IS NOT NULL)))) AS codes FROM so)"""


def _inputs(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id")
    number = F.floor(d / 2)
    digest = F.sha2(number.cast("string"), 256)
    chunks = docs.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat_ws(":", d.cast("string"), F.col("i").cast("string")).alias("chunk_id"),
        F.when(d % 50 != 0, number).alias("source_id"),
        F.when(d % 23 == 0, "e0").otherwise("e1").alias("epoch"),
        F.when(d % 9 != 0, F.when(d % 4 != 0, "APPROVED").otherwise("PENDING_REVIEW")).alias("approval_status"),
        F.when(d % 31 != 0, "someone").alias("approval_actor"),
        F.when(d % 37 == 0, "other").otherwise(digest).alias("approved_content_hash"),
        digest.alias("content_hash"),
        F.when(d % 3 == 0, "APPROVED_EXTERNAL").otherwise("UNTRUSTED").alias("trust_class"),
    )
    s = F.col("source_id")
    sources = docs.select(number.alias("source_id")).distinct().withColumn("h", F.sha2(s.cast("string"), 256))
    ledger = sources.where(s % 13 != 0).select("source_id", F.when(s % 11 == 0, "REJECTED").otherwise("APPROVED").alias("status"), F.when(s % 17 == 0, "old").otherwise(F.col("h")).alias("hash"))
    files = sources.where(s % 19 != 0).select("source_id", F.when(s % 29 == 0, "new").otherwise(F.col("h")).alias("hash"))
    gold = table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, ":7").otherwise(":0")).alias("chunk_id"))
    return chunks, ledger, files, gold


@register("source_approval_verdicts", f"WITH {_SQL} SELECT source AS source_id, n_chunks, array_to_string(codes, ',') AS codes, len(codes) = 0 AS verified FROM vd")
def source_approval_verdicts(spark, sf):
    """Each source of an index and all that speaks against it."""
    chunks, ledger, files, _ = _inputs(spark, sf)
    return approval.source_verdicts(chunks, ledger, files, "e1").withColumn("codes", F.array_join("codes", ","))


@register(
    "source_approval_report",
    f"""WITH {_SQL}, g AS (SELECT DISTINCT doc_id || CASE WHEN doc_id % 10 = 0 THEN ':7' ELSE ':0' END AS chunk_id FROM labels),
    gp AS (SELECT CASE WHEN ch.chunk_id IS NULL THEN 'gold_chunk_not_indexed' WHEN vd.source IS NULL OR len(vd.codes) > 0 THEN 'gold_chunk_unverified_source' END AS code FROM g LEFT JOIN ch USING (chunk_id) LEFT JOIN vd ON vd.source = ch.source),
    al AS (SELECT unnest(codes) AS code FROM vd UNION ALL SELECT code FROM gp WHERE code IS NOT NULL UNION ALL SELECT 'index_read_incomplete')
    SELECT code, count(*) AS n FROM al GROUP BY code UNION ALL SELECT 'verified', 0""",
)
def source_approval_report(spark, sf):
    """All problems of an index that says it has one chunk more than could be read."""
    chunks, ledger, files, gold = _inputs(spark, sf)
    declared = table(spark, sf, "documents").agg((F.count(F.lit(1)) * 2 + 1).alias("n"))
    return approval.approval_report(chunks, ledger, files, gold, "e1", declared)
