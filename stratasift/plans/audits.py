"""Queries that audit snapshots, provenance, vectors and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.functions import text, vectors
from stratasift.operators import contracts
from stratasift.sources import readers, sinks
from stratasift.staging import new_folder

from .catalog import register
from .fixtures import CHUNKS_SQL, chunks, table
from .retrieval_eval import _EVAL_SQL, _results


@register(
    "vector_status",
    """WITH v AS (SELECT label % 4 AS g, CASE WHEN label % 4 = 3 THEN NULL WHEN label % 4 = 2 AND vec_id % 5 = 0 THEN embedding[1:10] ELSE embedding END AS e FROM embeddings)
    SELECT g, CASE WHEN count(e) = 0 THEN 'empty' WHEN count_if(len(e) <> 64) > 0 THEN 'dimension_mismatch' ELSE 'ok' END AS status, count(e) AS n FROM v GROUP BY g""",
)
def vector_status(spark, sf):
    """Whether a group's vectors have a centroid: none, different lengths or fine."""
    kind = F.col("label") % 4
    given = F.when(kind == 3, None).when((kind == 2) & (F.col("vec_id") % 5 == 0), F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    rows = table(spark, sf, "embeddings").select(kind.alias("g"), given.alias("e"))
    return rows.groupBy("g").agg(vectors.centroid_status(F.col("e"), 64).alias("status"), F.count("e").alias("n"))


@register(
    "snapshot_report",
    f"""WITH {CHUNKS_SQL}, c AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 50 = 0 THEN '' ELSE chunk END AS chunk, CASE WHEN doc_id % 40 = 0 THEN NULL ELSE 'e1' END AS epoch FROM chunks WHERE doc_id % 30 <> 0)
    SELECT 'rows' AS check_name, count(*) AS n FROM c UNION ALL SELECT 'blank_content', count_if(chunk = '') FROM c UNION ALL SELECT 'missing_epoch', count_if(epoch IS NULL) FROM c
    UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM c UNION ALL SELECT 'missing_documents', (SELECT count(*) FROM documents) - count(DISTINCT doc_id) FROM c
    UNION ALL SELECT 'duplicate_chunks', count(*) - count(DISTINCT (doc_id, chunk_index)) FROM c""",
)
def snapshot_report(spark, sf):
    """What a snapshot has and lacks, as counts."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    c = chunks(docs.where(d % 30 != 0).select("doc_id", "text")).select(
        "doc_id", "chunk_index", F.when(d % 50 == 0, "").otherwise(F.col("chunk")).alias("chunk"), F.when(d % 40 != 0, "e1").alias("epoch")
    )
    return contracts.snapshot_counts(c, docs.select("doc_id"), ["doc_id", "chunk_index"], "chunk", "epoch")


@register(
    "hash_agreement",
    """WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents), i AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN sha256(h) ELSE h END AS h FROM b WHERE doc_id % 11 <> 0),
    l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(h) ELSE h END AS h FROM b WHERE doc_id % 5 <> 0)
    SELECT b.doc_id, CASE WHEN i.h IS NULL THEN 'not_indexed' WHEN l.h IS NULL THEN 'not_in_ledger' WHEN i.h <> b.h AND l.h <> b.h THEN 'bytes_differ' WHEN i.h <> b.h THEN 'index_differs' WHEN l.h <> b.h THEN 'ledger_differs' ELSE 'agree' END AS verdict
    FROM b LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)""",
)
def hash_agreement(spark, sf):
    """The hashes of the index, of the ledger and of the bytes, source by source."""
    d = F.col("doc_id")
    truth = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    again = F.sha2("h", 256)
    index = truth.where(d % 11 != 0).select("doc_id", F.when(d % 13 == 0, again).otherwise(F.col("h")).alias("h"))
    ledger = truth.where(d % 5 != 0).select("doc_id", F.when(d % 7 == 0, again).otherwise(F.col("h")).alias("h"))
    return contracts.hash_agreement(truth, index, ledger, "doc_id", "h")


@register(
    "provenance_codes",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'missing_source_id' END, CASE WHEN doc_id % 9 = 0 THEN 'missing_approval_status' END,
      CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 = 0 AND doc_id % 6 = 0 THEN 'approved_without_actor' END, CASE WHEN doc_id % 9 <> 0 AND doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 'approved_other_content' END,
      CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 AND doc_id % 4 <> 0 THEN 'trusted_without_approval' END], lambda x: x IS NOT NULL), ',') AS codes FROM documents""",
)
def provenance_codes(spark, sf):
    """What a chunk's provenance lacks or says against itself, each under its own code."""
    d = F.col("doc_id")
    approved = d % 4 == 0
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 10 != 0, "s").alias("source_id"),
        F.when(d % 9 != 0, F.when(approved, "APPROVED").otherwise("PENDING_REVIEW")).alias("approval_status"),
        F.when(d % 6 != 0, "someone").alias("approval_actor"),
        F.when(d % 8 == 0, "other").otherwise("h").alias("approved_content_hash"),
        F.lit("h").alias("content_hash"),
        F.when(d % 3 == 0, "APPROVED_EXTERNAL").otherwise("UNTRUSTED").alias("trust_class"),
    )
    return rows.select("doc_id", F.array_join(contracts.provenance_reasons(), ",").alias("codes"))


@register(
    "epoch_store",
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'e1' ELSE 'e2' END AS epoch, doc_id, sha256(text) AS content, CASE WHEN doc_id % 2 = 0 THEN (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) END AS sealed_rows FROM documents""",
)
def epoch_store(spark, sf):
    """Two epochs written, one of them sealed, and what is read back from their own folders beside what the seal says."""
    schema = T.StructType.fromDDL("doc_id bigint, content string, doc_version_epoch string")
    store = sinks.EpochStore(spark, new_folder(spark, "epochs"), schema)
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    for n, epoch in enumerate(("e1", "e2")):
        store.replace(epoch, docs.where(F.col("doc_id") % 2 == n).withColumn("doc_version_epoch", F.lit(epoch)))
        if not n:
            store.seal(epoch)
    both = store.read("e1").unionByName(store.read("e2")).withColumnRenamed("doc_version_epoch", "epoch")
    sealed = store.sealed().select("epoch", F.col("n_rows").alias("sealed_rows"))
    return both.join(F.broadcast(sealed), "epoch", "left").select("epoch", "doc_id", "content", "sealed_rows")


@register(
    "benchmark_artifacts",
    f"WITH {_EVAL_SQL} SELECT query, business_type, recall_10, rr, ndcg FROM res",
)
def benchmark_artifacts(spark, sf):
    """Results by query as JSON lines, nulls written out, as a later comparison reads them."""
    folder = new_folder(spark, "artifacts")
    rows = _results(spark, sf).select("query", "business_type", "recall_10", "rr", "ndcg")
    rows.write.option("ignoreNullFields", "false").json(folder)
    return readers.read_json_lines(spark, folder, "query long, business_type string, recall_10 double, rr double, ndcg double")


@register(
    "passage_risk",
    r"""WITH qw AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS t FROM benchmark),
    a AS (SELECT item_id, substr(text, 1, length(text) // 2) AS question, text FROM benchmark), w AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(question, '[A-Za-z0-9]+'), lambda x: lower(x))) AS t FROM a),
    c AS (SELECT a.item_id, count(w.t) AS n, count(qw.t) AS k FROM a LEFT JOIN w USING (item_id) LEFT JOIN qw ON qw.item_id = w.item_id AND qw.t = w.t GROUP BY a.item_id)
    SELECT a.item_id, round(length(question) / length(text), 3) AS run_share, round(k / n, 6) AS coverage, CASE WHEN length(question) / length(text) >= 0.5 OR k / n >= 0.9 THEN 'HIGH' WHEN length(question) / length(text) >= 0.3 OR k / n >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM a JOIN c USING (item_id)""",
)
def passage_risk(spark, sf):
    """How much of its passage a question gives away: the longest run that both have, and the words of it that the passage has."""
    q = F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    rows = table(spark, sf, "benchmark").select("item_id", q.alias("question"), "text")
    run = text.longest_common_substring(F.col("question"), F.col("text"))
    words, known = text.cjk_and_word_tokens(F.col("question")), text.cjk_and_word_tokens(F.col("text"))
    shares = rows.select(
        "item_id", (run / F.length("text")).alias("run_share"), F.try_divide(F.size(F.array_intersect(words, known)), F.size(words)).alias("coverage")
    )
    level = F.when((F.col("run_share") >= 0.5) | (F.col("coverage") >= 0.9), "HIGH").when((F.col("run_share") >= 0.3) | (F.col("coverage") >= 0.75), "MEDIUM")
    return shares.select("item_id", F.round("run_share", 3).alias("run_share"), F.round("coverage", 6).alias("coverage"), level.otherwise("LOW").alias("level"))
