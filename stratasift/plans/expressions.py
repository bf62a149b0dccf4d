"""Queries over column functions that have none elsewhere, and over rules that need several of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import access, ids, redaction, text, vectors
from stratasift.operators import contracts, corpus, evaluation, extension, ops

from .catalog import register
from .corpus import _ledger, _sources, _TRUST_SQL
from .fixtures import table


@register(
    "request_ids",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new-' || event_id ELSE 'r.' || event_id END AS request_id FROM events",
)
def request_ids(spark, sf):
    """An identifier that the caller sends is taken if it is harmless."""
    name = F.col("event_id").cast("string")
    sent = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("bad id/"), name)).otherwise(F.concat(F.lit("r."), name))
    return table(spark, sf, "events").select("event_id", redaction.request_id(sent, F.concat(F.lit("new-"), name)).alias("request_id"))


@register(
    "cache_keys",
    """SELECT event_id, sha256('{"business":"' || event_type || '","epoch":' || CASE WHEN event_id % 2 = 0 THEN '"e1"' ELSE 'null' END || ',"session":"s' || user_id % 7 || '","user":' || user_id || '}') AS key FROM events""",
)
def cache_keys(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        ids.cache_key(
            user=F.col("user_id"),
            business=F.col("event_type"),
            session=F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")),
            epoch=F.when(F.col("event_id") % 2 == 0, "e1"),
        ).alias("key"),
    )


@register("epoch_names", "SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y%m%d_%H%M%S') AS epoch FROM events")
def epoch_names(spark, sf):
    return table(spark, sf, "events").select(ids.epoch_name(F.date_trunc("hour", "ts")).alias("epoch")).distinct()


@register("token_cuts", "SELECT doc_id, length(substr(text, 1, greatest(CAST(floor(length(text) * 2 / 3.0) AS BIGINT), 128))) AS n FROM documents")
def token_cuts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(text.token_cut(F.col("text"))).cast("long").alias("n"))


@register(
    "allowed_attributes",
    "SELECT event_id, k AS name, v AS value FROM events, LATERAL (VALUES ('type', event_type), ('api_token', '[REDACTED]'), ('props', substr(repeat(props, 100), 1, 256))) t(k, v)",
)
def allowed_attributes(spark, sf):
    """Known attributes only, without credentials and not too long."""
    m = F.create_map(
        F.lit("type"), F.col("event_type"), F.lit("api_token"), F.lit("t"), F.lit("props"), F.repeat("props", F.lit(100)), F.lit("user"), F.lit("u")
    )
    rows = table(spark, sf, "events")
    return rows.select("event_id", F.explode(redaction.allowed_attributes(m, ["type", "api_token", "props"])).alias("name", "value"))


@register(
    "mask_checks",
    "SELECT doc_id, m AS mask, m IS NOT NULL AND m BETWEEN 0 AND 4294967295 AS valid FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 4294967296 WHEN 3 THEN 4294967295 ELSE 0 END AS m FROM documents)",
)
def mask_checks(spark, sf):
    d = F.col("doc_id") % 5
    mask = F.when(d == 1, -1).when(d == 2, 4294967296).when(d == 3, 4294967295).when(d == 4, 0).cast("long")
    return table(spark, sf, "documents").select("doc_id", mask.alias("mask"), F.coalesce(access.mask_valid(mask), F.lit(False)).alias("valid"))


@register(
    "sample_selection",
    "SELECT item_id, text FROM benchmark WHERE item_id IN (SELECT item_id FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR)) LIMIT 5)",
)
def sample_selection(spark, sf):
    """Wanted rows by their ids; one that is missing would stop the run."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    wanted = [r[0] for r in b.orderBy(F.md5(F.col("item_id").cast("string"))).select("item_id").limit(5).collect()]
    return contracts.select_samples(b, "item_id", wanted)


@register("nfkc_passages")
def nfkc_passages(spark, sf):
    """The full normal form of passages with compatibility characters; Spark and SQL have no NFKC."""
    marked = F.concat(F.lit("ﬁ Ａ² ① "), "text")
    return table(spark, sf, "benchmark").select("item_id", F.sha2(text.nfkc_passage(marked), 256).alias("passage_hash"))


@register(
    "embedded_texts",
    "SELECT item_id, CAST(length(text) AS DOUBLE) AS x, round(CAST(length(text) AS DOUBLE) / sqrt(length(text) * length(text) + 1), 6) AS unit FROM benchmark",
)
def embedded_texts(spark, sf):
    """Vectors from a model that the caller brings, scaled to length one."""

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = table(spark, sf, "benchmark").select("item_id", extension.embed(F.col("text"), load).alias("v"))
    unit = vectors.l2_normalize(F.col("v"))
    return rows.select("item_id", F.col("v")[0].cast("double").alias("x"), F.round(unit[0], 6).alias("unit"))


@register(
    "masked_mean_pooling",
    """WITH t AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) FILTER (vec_id % 3 <> 0) AS m FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY label, i),
    n AS (SELECT label, sqrt(sum(m * m)) AS n FROM t GROUP BY label) SELECT t.label, CAST(i - 1 AS INTEGER) AS i, round(m / n, 6) AS x FROM t JOIN n USING (label)""",
)
def masked_mean_pooling(spark, sf):
    """Vectors stand for a text's tokens, every third of them padding; the others' mean is scaled to length one."""
    e = table(spark, sf, "embeddings")
    tokens = e.groupBy("label").agg(F.collect_list(F.struct((F.col("vec_id") % 3 != 0).alias("on"), F.col("embedding").alias("v"))).alias("tokens"))
    pooled = vectors.l2_normalize(vectors.masked_mean(F.transform("tokens", lambda t: t["v"]), F.transform("tokens", lambda t: t["on"]), 64))
    return tokens.select("label", F.posexplode(pooled).alias("i", "x")).withColumn("x", F.round("x", 6))


@register(
    "prometheus_metrics",
    """WITH c AS (SELECT event_type AS t, count(*) AS n, max(event_id) AS g, list_sort(list(value)) AS v FROM events GROUP BY event_type)
    SELECT t, 1 AS part, '# TYPE rag_requests_' || t || ' counter' || chr(10) || 'rag_requests_' || t || ' ' || n AS lines FROM c
    UNION ALL SELECT t, 2, '# TYPE rag_last_event_' || t || ' gauge' || chr(10) || 'rag_last_event_' || t || ' ' || g FROM c
    UNION ALL SELECT t, 3, string_agg('rag_value_' || t || '{quantile="' || q || '"} ' || printf('%.2f', round(v[least(CAST(floor(n * q) AS BIGINT), n - 1) + 1], 2)), chr(10) ORDER BY q) FROM c, (VALUES (0.5), (0.95), (0.99)) p(q) GROUP BY t""",
)
def prometheus_metrics(spark, sf):
    """Counters, gauges and quantiles in the text format."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("g"))

    def typed(part, name, kind, value):
        full = F.concat(F.lit(f"rag_{name}_"), t)
        return counts.select(t.alias("t"), F.lit(part).alias("part"), F.concat(F.lit("# TYPE "), full, F.lit(f" {kind}\n"), full, F.lit(" "), F.col(value).cast("string")).alias("lines"))

    points = evaluation.floor_percentiles(e, ["event_type"], "value")
    lines = [F.concat(F.lit("rag_value_"), t, F.lit(f'{{quantile="{q:.2f}"}} '), F.format_string("%.2f", f"p{round(q * 100)}")) for q in (0.5, 0.95, 0.99)]
    quantiles = points.select(t.alias("t"), F.lit(3).alias("part"), F.concat_ws("\n", *lines).alias("lines"))
    return typed(1, "requests", "counter", "n").unionByName(typed(2, "last_event", "gauge", "g")).unionByName(quantiles)


@register(
    "answer_eval_full",
    """WITH a AS (SELECT d.lang AS category, CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported' ELSE 'partially_supported' END AS support, l.doc_id % 6 <> 0 AS answered, l.doc_id % 5 = 0 AS high_risk, l.doc_id % 17 = 0 AS leak
      FROM labels l JOIN documents d USING (doc_id))
    SELECT category, count(*) AS n, round(count_if(answered AND support = 'supported') / nullif(count_if(answered), 0), 6) AS support_strict, round(count_if(answered AND support <> 'unsupported') / nullif(count_if(answered), 0), 6) AS support_inclusive,
      count_if(leak) AS rbac_leaks, count_if(answered AND high_risk) AS high_risk_n, round(count_if(answered AND high_risk AND support = 'unsupported') / nullif(count_if(answered AND high_risk), 0), 6) AS high_risk_unsupported FROM a GROUP BY GROUPING SETS ((category), ())""",
)
def answer_eval_full(spark, sf):
    """Support in the strict and the inclusive sense, leaks, and unsupported answers where the risk is high."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"))
    support = F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "supported").otherwise("partially_supported")
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        "category", support.alias("support"), (d % 6 != 0).alias("answered"), (d % 5 == 0).alias("high_risk"), (d % 17 == 0).alias("leak")
    )
    return contracts.answer_rates(rows, "category")


@register(
    "observation_integrity",
    """WITH o AS (SELECT CASE WHEN doc_id % 9 = 0 THEN doc_id + 1000000 ELSE doc_id END AS sample_id FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 1)
    SELECT sample_id, 'unknown' AS problem FROM o WHERE sample_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT sample_id, 'duplicate' FROM o GROUP BY sample_id HAVING count(*) > 1
    UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT sample_id FROM o)""",
)
def observation_integrity(spark, sf):
    """Observations of no sample, twice of one, and samples without any."""
    d = F.col("doc_id")
    labels = table(spark, sf, "labels").select("doc_id")
    observed = labels.where(d % 7 != 0).select(F.when(d % 9 == 0, d + 1_000_000).otherwise(d).alias("sample_id")).unionByName(
        labels.where(d % 10 == 1).select(d.alias("sample_id"))
    )
    return contracts.observation_problems(labels.select(d.alias("sample_id")), observed, "sample_id")


@register(
    "sample_set_hashes",
    f"""WITH h AS (SELECT lang, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), {corpus.ordered_digest_sql('f', 'h', 'lang')}
    SELECT lang, d AS any_order, n AS n_samples FROM f""",
)
def sample_set_hashes(spark, sf):
    """Runs are comparable if they had the same samples, in whatever order."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    digests = corpus.ordered_digest(rows.select("lang", "doc_id"), F.col("doc_id").cast("string"), ["lang"])
    return digests.select("lang", F.col("digest").alias("any_order"), F.col("n_rows").alias("n_samples"))


@register(
    "trust_approvers",
    f"""WITH {_TRUST_SQL}, p AS (SELECT source_id, 'text' AS kind FROM src UNION ALL SELECT source_id, 'image' FROM src WHERE CAST(substr(source_id, 4) AS INT) % 4 = 0)
    SELECT trust_class, count(DISTINCT c.source_id) AS n_sources, count(*) AS n_points, count(DISTINCT CASE WHEN approval IN ('APPROVED', 'REJECTED') THEN 'reviewer' || CAST(substr(c.source_id, 4) AS INT) % 3 END) AS n_approvers FROM classed c JOIN p USING (source_id) GROUP BY trust_class""",
)
def trust_approvers(spark, sf):
    """Classes and distinct approvers over the text and image points of all sources."""
    src = _sources(spark, sf)
    classed = corpus.resolve_trust(src, _ledger(src))
    k = F.substring("source_id", 4, 10).cast("int")
    points = src.select("source_id").unionByName(src.where(k % 4 == 0).select("source_id"))
    by = F.when(F.col("approval").isin("APPROVED", "REJECTED"), F.concat(F.lit("reviewer"), (k % 3).cast("string")))
    return classed.join(points, "source_id").groupBy("trust_class").agg(
        F.countDistinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_points"), F.countDistinct(by).alias("n_approvers")
    )


@register(
    "batch_flush",
    """WITH b AS (SELECT *, time_bucket(interval 10 minute, ts) AS w FROM events), k AS (SELECT *, (row_number() OVER (PARTITION BY w ORDER BY ts, event_id) - 1) // 4 AS part FROM b),
    f AS (SELECT w, part, count(*) AS n, max(epoch_us(ts)) AS last, min(epoch_us(ts)) AS first FROM k GROUP BY w, part)
    SELECT n AS items, count(*) AS batches, round(avg((last - first) / 1000000.0), 6) AS mean_delay, round(avg(n / 4.0), 6) AS utilisation FROM f GROUP BY n""",
)
def batch_flush(spark, sf):
    """Micro-batches close after ten minutes or as soon as they are full (here: four requests)."""
    return ops.flushed_batches(table(spark, sf, "events"), "ts", "event_id", "10 minutes", 4)
