"""Queries over failures, retries, image paths, alerts, caches and measured runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import rules
from stratasift.operators import extension, lexical, ops
from stratasift.sources import sinks
from stratasift.staging import new_folder

from .catalog import register
from .fixtures import table
from .retrieval_eval import BM25, _top, ranked_sql

_KINDS = ["ImportError", "FileNotFoundError", "OSError", "ValueError", "UnexpectedResponse", "LinAlgError", "RuntimeError", "KeyError"]
_KIND_SQL = f"[{', '.join(repr(k) for k in _KINDS)}][CAST(event_id % 8 + 1 AS BIGINT)]"


@register(
    "failure_taxonomy",
    f"""WITH f AS (SELECT event_id, {_KIND_SQL} AS kind, CASE WHEN event_id % 3 = 0 THEN 'CLIP weights' ELSE 'other' END AS message FROM events)
    SELECT event_id, CASE WHEN kind IN ('ImportError', 'FileNotFoundError', 'OSError') THEN 'model_unavailable' WHEN kind = 'ValueError' THEN 'dimension_mismatch' WHEN kind = 'UnexpectedResponse' THEN 'qdrant_failed'
      WHEN kind = 'LinAlgError' THEN 'encode_failed' WHEN kind = 'RuntimeError' AND message = 'CLIP weights' THEN 'model_unavailable' ELSE 'unknown' END AS outcome,
      CASE WHEN kind = 'ImportError' THEN 'not_installed' WHEN kind IN ('FileNotFoundError', 'OSError') THEN 'missing_weights' WHEN kind = 'ValueError' THEN 'query_vs_collection' WHEN kind = 'UnexpectedResponse' THEN 'qdrant_error'
      WHEN kind = 'LinAlgError' THEN 'encoder_error' WHEN kind = 'RuntimeError' AND message = 'CLIP weights' THEN 'loader_error' ELSE 'unclassified' END AS detail FROM f""",
)
def failure_taxonomy(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 8 + 1).cast("int"))
    message = F.when(F.col("event_id") % 3 == 0, "CLIP weights").otherwise("other")
    outcome, detail = rules.path_failure(kind, message)
    return table(spark, sf, "events").select("event_id", outcome.alias("outcome"), detail.alias("detail"))


@register(
    "transport_failures",
    """WITH f AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [400, 408, 429, 500, 502, 503, 504][CAST(event_id % 7 + 1 AS BIGINT)] END AS status,
      ['ReadTimeout', 'ConnectError', 'KeyError', 'Strange'][CAST(event_id % 4 + 1 AS BIGINT)] AS kind FROM events)
    SELECT event_id, CASE WHEN status IN (408, 429, 502, 503, 504) THEN 'http_transient' WHEN status IS NOT NULL THEN 'http_permanent' WHEN kind = 'ReadTimeout' THEN 'timeout'
      WHEN kind = 'ConnectError' THEN 'connection' WHEN kind = 'KeyError' THEN 'malformed_response' ELSE 'unknown' END AS failure FROM f""",
)
def transport_failures(spark, sf):
    e = F.col("event_id")
    status = F.when(e % 2 == 0, F.element_at(F.array(*map(F.lit, (400, 408, 429, 500, 502, 503, 504))), (e % 7 + 1).cast("int")))
    kind = F.element_at(F.array(*map(F.lit, ("ReadTimeout", "ConnectError", "KeyError", "Strange"))), (e % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", rules.transport_failure(status, kind).alias("failure"))


_HEADERS = ["5", " 2.5 ", "abc", "-1", "Wed, 21 Oct 2015 07:28:00 GMT", "inf", "120", "0"]


@register(
    "retry_delay",
    f"""WITH h AS (SELECT event_id, CASE WHEN event_id % 9 < 8 THEN [{', '.join(f"'{x}'" for x in _HEADERS)}][CAST(event_id % 9 + 1 AS BIGINT)] END AS header, event_id % 4 + 1 AS attempts FROM events),
    p AS (SELECT *, CASE WHEN TRY_CAST(trim(header) AS DOUBLE) >= 0 AND isfinite(TRY_CAST(trim(header) AS DOUBLE)) THEN TRY_CAST(trim(header) AS DOUBLE) END AS asked FROM h)
    SELECT event_id, asked, CASE WHEN asked > 8 THEN NULL ELSE greatest(least(0.5 * 2 ** (attempts - 1), 8), coalesce(asked, 0)) END AS delay FROM p""",
)
def retry_delay(spark, sf):
    """Doubling waits, raised to what the server asks for; null where that is beyond the policy."""
    e = F.col("event_id")
    header = F.when(e % 9 < 8, F.try_element_at(F.array(*map(F.lit, _HEADERS)), (e % 9 + 1).cast("int")))
    asked = rules.retry_after(header)
    return table(spark, sf, "events").select("event_id", asked.alias("asked"), rules.backoff_delay(e % 4 + 1, asked, 0.5, 8.0).alias("delay"))


@register(
    "image_path_metrics",
    """WITH f AS (SELECT ['ok', 'empty', 'timeout', 'busy', 'unset', 'encode_failed'][CAST(event_id % 6 + 1 AS BIGINT)] AS outcome, CASE WHEN event_id % 6 = 5 THEN 'encoder_error' ELSE '' END AS detail, value FROM events)
    SELECT outcome, detail, count(*) AS attempts, CASE WHEN outcome IN ('ok', 'empty', 'unset') THEN 0 ELSE count(*) END AS degraded, round(avg(value), 6) AS mean_ms FROM f GROUP BY outcome, detail""",
)
def image_path_metrics(spark, sf):
    """An empty result is a success; everything that is neither that nor a hit is a degraded path."""
    e = F.col("event_id")
    outcome = F.element_at(F.array(*map(F.lit, ("ok", "empty", "timeout", "busy", "unset", "encode_failed"))), (e % 6 + 1).cast("int"))
    rows = table(spark, sf, "events").select(outcome.alias("outcome"), F.when(e % 6 == 5, "encoder_error").otherwise("").alias("detail"), "value")
    return ops.path_metrics(rows, "outcome", "detail", "value")


@register(
    "alert_notifications",
    """WITH f AS (SELECT *, value > 150 AS bad FROM events), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f),
    a AS (SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS n FROM r WHERE bad GROUP BY user_id, run HAVING floor(epoch(max(ts))) - floor(epoch(min(ts))) >= 3600)
    SELECT user_id, since, until, n, row_number() OVER (PARTITION BY user_id ORDER BY since) = 1 AS notified FROM a""",
)
def alert_notifications(spark, sf):
    """Alerts come and go; each rule (here: user) notifies once."""
    alerts = ops.sustained(table(spark, sf, "events"), ["user_id"], "ts", F.col("value") > 150, 3600)
    return alerts.withColumn("notified", F.row_number().over(Window.partitionBy("user_id").orderBy("since")) == 1)


@register("two_level_cache")
def two_level_cache(spark, sf):
    """Users stand for nodes, values for keys, months' thirds for epochs."""
    e = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.concat_ws(":", (F.col("event_id") % 5).cast("string"), (F.col("event_id") % 2).cast("string")).alias("key"),
        (F.col("event_id") % 2 == 0).alias("public"),
        F.floor(F.dayofmonth("ts") / 10).cast("int").alias("epoch"),
    )
    return ops.two_level_cache(e, ["user_id"], "key", "ts", "public", (2, 300_000), 600_000, "epoch").select("event_id", "served")


@register(
    "keyset_page",
    "SELECT key, doc_id FROM (SELECT md5(CAST(doc_id AS VARCHAR)) AS key, doc_id FROM documents) WHERE key > '8' ORDER BY key LIMIT 500",
)
def keyset_page(spark, sf):
    """One page of the index after a given key; the limit is the page's size."""
    rows = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("key"), "doc_id")
    return lexical.keyset_page(rows, "key", "8", 500)


@register(
    "performance_artifact",
    """WITH m AS (SELECT count(*) AS total, count_if(event_type = 'error') AS failed, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events),
    f(part, field, value) AS (SELECT 'errors', 'total', CAST(total AS DOUBLE) FROM m UNION ALL SELECT 'errors', 'failed', failed FROM m UNION ALL SELECT 'errors', 'error_rate', round(failed / total, 6) FROM m
      UNION ALL SELECT 'latency', 'p50', p50 FROM m UNION ALL SELECT 'latency', 'p99', p99 FROM m UNION ALL SELECT 'throughput', 'qps', NULL)
    SELECT part, field, value FROM f""",
)
def performance_artifact(spark, sf):
    """Written to files and read back: what was not measured is null, never zero."""
    failed = F.count_if(F.col("event_type") == "error")
    one = table(spark, sf, "events").agg(
        F.count(F.lit(1)).cast("double").alias("errors_total"),
        failed.cast("double").alias("errors_failed"),
        F.round(failed / F.count(F.lit(1)), 6).alias("errors_error_rate"),
        F.round(F.percentile("value", 0.5), 6).alias("latency_p50"),
        F.round(F.percentile("value", 0.99), 6).alias("latency_p99"),
        F.lit(None).cast("double").alias("throughput_qps"),
    )
    folder = new_folder(spark, "performance")
    sinks.write_artifact(one, folder, ("errors", "latency", "throughput"))
    return sinks.read_artifact(spark, folder, ("errors", "latency", "throughput"))


@register(
    "ensemble_rerank",
    f"""WITH {BM25}, {ranked_sql('r', 'scored', 20)}, s AS (SELECT query, doc, rank, query % 7 = 0 AS failed, (length(d.text) % 1000 / 1000.0 + length(b.text) / 400.0) / 2 AS raw FROM r JOIN documents d ON d.doc_id = r.doc JOIN benchmark b ON b.item_id = r.query),
    p AS (SELECT *, CASE WHEN failed THEN NULL ELSE round(1 / (1 + exp(-raw)), 6) END AS score FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, rank) AS place FROM p)
    SELECT query, doc, score, place, CASE WHEN failed THEN 'deterministic_fallback' ELSE 'cross_encoder' END AS provenance FROM o WHERE place <= 10""",
)
def ensemble_rerank(spark, sf):
    """The mean of two scorers, calibrated; where one fails, a query keeps the order in which it came."""
    top = _top(spark, sf, 20).select("query", "doc", "rank")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("size"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.length("text").alias("words"))
    pairs = top.join(docs, "doc").join(asked, "query")
    a = F.when(F.col("query") % 7 != 0, F.col("size") % 1000 / 1000.0)
    return extension.ensemble_rerank(pairs, [a, F.col("words") / 400.0], 10)
