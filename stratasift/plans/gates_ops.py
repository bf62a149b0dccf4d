"""Queries over gates, routing, experiments and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import ids, redaction, rules, text
from stratasift.operators import evaluation, fusion, lexical, ops

from .catalog import register
from .fixtures import table
from .retrieval_eval import PATHS_SQL, _top_paths

# --- gates -----------------------------------------------------------------

_TOP3_SQL = f"""{PATHS_SQL}, top3 AS (SELECT query, doc, score / 40 AS score, rank FROM r1 WHERE rank <= 3),
agree AS (SELECT a.query, round(len(list_intersect(a.docs, b.docs)) / len(list_distinct(list_concat(a.docs, b.docs))), 6) AS agreement
  FROM (SELECT query, list(DISTINCT doc) AS docs FROM r1 WHERE rank <= 10 GROUP BY query) a JOIN (SELECT query, list(DISTINCT doc) AS docs FROM r2 WHERE rank <= 10 GROUP BY query) b ON a.query = b.query),
txt AS (SELECT t.query, t.rank, substr(d.text, 1, 512) AS text FROM top3 t JOIN documents d ON d.doc_id = t.doc),
cs AS (SELECT query, rank, list_distinct(list_filter(string_split(text, ''), lambda x: x <> '')) AS c FROM txt),
pairs AS (SELECT a.query, CASE WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 0.1 ELSE
   greatest(0, least(0.3 * len(list_filter(b.c, lambda x: NOT list_contains(a.c, x))) / len(a.c), 0.6)) END AS contra
  FROM cs a JOIN cs b ON a.query = b.query AND a.rank < b.rank),
cons AS (SELECT q.query, coalesce(1 - count_if(contra > 0.5) / nullif(count(contra), 0), 1) AS consistency
  FROM (SELECT DISTINCT query FROM top3) q LEFT JOIN pairs USING (query) GROUP BY q.query)"""


def _top3(top_paths):
    top = top_paths.where("path = 'bm25_es' and rank <= 3")
    return top.select("query", "doc", "rank", (F.col("score") / 40).alias("score"))


def _consistency(spark, sf, top3):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.substring("text", 1, 512).alias("text"))
    texts = top3.select("query", "rank", "doc").join(docs, "doc")
    a, b = texts.alias("a"), texts.select("query", F.col("rank").alias("rank_b"), F.col("text").alias("text_b"))
    pairs = a.join(b, "query").where(F.col("rank") < F.col("rank_b"))
    contra, _ = text.overlap_entailment(F.col("text"), F.col("text_b"))
    per = pairs.groupBy("query").agg((1 - F.avg((contra > 0.5).cast("double"))).alias("consistency"))
    return top3.select("query").distinct().join(per, "query", "left").select("query", F.coalesce("consistency", F.lit(1.0)).alias("consistency"))


@register("doc_consistency", f"WITH {_TOP3_SQL} SELECT query, round(consistency, 6) AS consistency FROM cons")
def doc_consistency(spark, sf):
    return _consistency(spark, sf, _top3(_top_paths(spark, sf, 3))).withColumn("consistency", F.round("consistency", 6))


@register(
    "evidence_gate",
    f"""WITH {_TOP3_SQL}, s AS (SELECT query, max(CASE WHEN rank = 1 THEN score END) AS top1, avg(score) AS mean3 FROM top3 GROUP BY query),
    e AS (SELECT s.query, round(0.4 * top1 + 0.3 * mean3 + 0.2 * coalesce(agreement, 0) + 0.1 * consistency, 6) AS evidence_score, coalesce(agreement, 0) < 0.3 AS strict
      FROM s LEFT JOIN agree USING (query) JOIN cons USING (query))
    SELECT query, evidence_score, CASE WHEN evidence_score >= CASE WHEN strict THEN 0.80 ELSE 0.75 END THEN 'pass'
      WHEN evidence_score >= CASE WHEN strict THEN 0.65 ELSE 0.55 END THEN 'enhanced_generate' ELSE 'reject' END AS decision FROM e""",
)
def evidence_gate(spark, sf):
    paths = _top_paths(spark, sf, 10)
    top = _top3(paths)
    s = top.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.avg("score").alias("mean3"))
    joined = s.join(fusion.path_agreement(paths), "query", "left").join(_consistency(spark, sf, top), "query")
    agreement = F.coalesce("agreement", F.lit(0.0))
    score = rules.evidence_score(0.4 * F.col("top1") + 0.3 * F.col("mean3") + 0.2 * agreement + 0.1 * F.col("consistency"))
    return joined.select(
        "query", score.alias("evidence_score"), rules.evidence_decision(score, agreement, F.lit(False)).alias("decision")
    )


_PAIR_SQL = """p AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS doc, a.conv_id % 2 = 0 AS reg
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
g AS (SELECT *, list_distinct(list_transform(range(1, greatest(1, length(substr(answer, 1, 500)) - 1)), lambda i: substr(substr(answer, 1, 500), CAST(i AS BIGINT), 3))) AS ga,
  list_distinct(list_transform(range(1, greatest(1, length(substr(doc, 1, 500)) - 1)), lambda i: substr(substr(doc, 1, 500), CAST(i AS BIGINT), 3))) AS gd FROM p),
j AS (SELECT *, CASE WHEN len(ga) = 0 OR len(gd) = 0 THEN 0 ELSE len(list_intersect(ga, gd)) / len(list_distinct(list_concat(ga, gd))) END AS similarity FROM g),
c AS (SELECT *, list_distinct(list_filter(string_split(doc, ''), lambda x: x <> '')) AS cp, list_distinct(list_filter(string_split(answer, ''), lambda x: x <> '')) AS ch FROM j),
n AS (SELECT *, CASE WHEN len(cp) = 0 OR len(ch) = 0 THEN 0.3 ELSE least(1.2 * len(list_intersect(cp, ch)) / len(list_distinct(list_concat(cp, ch))), 0.9) END AS entail,
  CASE WHEN len(cp) = 0 OR len(ch) = 0 THEN 0.1 ELSE greatest(0, least(0.3 * len(list_filter(ch, lambda x: NOT list_contains(cp, x))) / len(cp), 0.6)) END AS contra FROM c)"""


def _answer_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    # The turn before an answer stands for its evidence.
    w = Window.partitionBy("conv_id").orderBy("turn")
    prior = F.when(F.lag("turn").over(w) == F.col("turn") - 1, F.lag("text").over(w))
    return c.withColumn("doc", prior).where("role = 'assistant' and doc is not null").select(
        "conv_id", "turn", F.col("text").alias("answer"), "doc", (F.col("conv_id") % 2 == 0).alias("reg")
    )


@register("answer_gate_jaccard", f"WITH {_PAIR_SQL} SELECT conv_id, turn, round(similarity, 6) AS similarity FROM n")
def answer_gate_jaccard(spark, sf):
    return _answer_pairs(spark, sf).select(
        "conv_id", "turn", F.round(text.ngram_jaccard(F.col("answer"), F.col("doc")), 6).alias("similarity")
    )


@register(
    "answer_gate_nli_fallback",
    f"""WITH {_PAIR_SQL}, v AS (SELECT *, CASE WHEN similarity < 0.15 THEN 0.6 ELSE contra END AS used FROM n)
    SELECT conv_id, turn, round(contra, 6) AS contradiction, round(entail, 6) AS entailment,
      CASE WHEN similarity > 0.6 THEN true WHEN similarity < 0.15 THEN NOT reg ELSE used <= CASE WHEN reg THEN 0.5 ELSE 0.6 END END AS passed,
      CASE WHEN similarity > 0.6 THEN false WHEN similarity < 0.15 THEN true ELSE used > 0.5 END AS warned FROM v""",
)
def answer_gate_nli_fallback(spark, sf):
    p = _answer_pairs(spark, sf)
    contra, entail = text.overlap_entailment(F.col("doc"), F.col("answer"))
    scored = p.select("conv_id", "turn", "reg", text.ngram_jaccard(F.col("answer"), F.col("doc")).alias("similarity"), contra.alias("c"), entail.alias("e"))
    passed, warned = rules.answer_verdict(F.col("similarity"), F.col("c"), F.col("reg"), F.lit(True))
    return scored.select(
        "conv_id", "turn", F.round("c", 6).alias("contradiction"), F.round("e", 6).alias("entailment"), passed.alias("passed"), warned.alias("warned")
    )


@register(
    "outcome_class",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected_by_answer_gate' WHEN event_id % 7 = 0 THEN 'rejected_by_evidence_gate' WHEN event_id % 11 = 0 THEN 'error'
      WHEN event_type = 'purchase' THEN 'answered' WHEN event_id % 3 = 0 THEN 'cache_hit' WHEN event_id % 5 = 0 THEN 'rejected_by_admission' ELSE 'rejected_by_evidence_gate' END AS outcome FROM events""",
)
def outcome_class(spark, sf):
    e = F.col("event_id")
    evidence = F.when(e % 7 == 0, "reject").when(e % 5 == 0, None).otherwise("pass")
    return table(spark, sf, "events").select(
        "event_id",
        rules.request_outcome(
            F.col("event_type") != "error", evidence, e % 11 == 0, F.col("event_type") == "purchase", F.when(e % 3 == 0, "L1")
        ).alias("outcome"),
    )


_KW = ["the", "der", "que", "les", "and", "die"]
_KW_SQL = " + ".join(f"CAST(contains(text, '{k}') AS INT)" for k in _KW)


@register("complexity_rule", f"SELECT conv_id, turn, ({_KW_SQL}) >= 2 AS is_complex FROM conversations")
def complexity_rule(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", rules.is_complex(F.col("text"), _KW).alias("is_complex"))


_GROUPS = [(["und", "der"], "regulation", "compliance"), (["que", "les"], "development", "formulation"), (["ing"], "ingredient", "ingredient")]


@register(
    "intent_rule",
    """SELECT conv_id, turn, CASE WHEN contains(text, 'und') OR contains(text, 'der') THEN 'regulation' WHEN contains(text, 'que') OR contains(text, 'les') THEN 'development'
      WHEN contains(text, 'ing') THEN 'ingredient' ELSE 'general' END AS business_type,
      CASE WHEN contains(text, 'und') OR contains(text, 'der') THEN 'compliance' WHEN contains(text, 'que') OR contains(text, 'les') THEN 'formulation'
      WHEN contains(text, 'ing') THEN 'ingredient' ELSE 'general' END AS intent FROM conversations""",
)
def intent_rule(spark, sf):
    business, intent = rules.intent(F.col("text"), _GROUPS)
    return table(spark, sf, "conversations").select("conv_id", "turn", business.alias("business_type"), intent.alias("intent"))


@register(
    "visual_route",
    f"""SELECT conv_id, turn, CASE WHEN s >= 0.5 THEN 50 WHEN s >= 0.2 THEN 20 ELSE 0 END AS top_k FROM (SELECT *, greatest(least(({_KW_SQL}) * 0.3, 1.0),
      CASE WHEN contains(text, 'ing') THEN 0.3 ELSE 0 END, (conv_id % 10) / 20.0) AS s FROM conversations)""",
)
def visual_route(spark, sf):
    intent = F.when(F.contains("text", F.lit("ing")), "ingredient").otherwise("general")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", rules.visual_route(text.keyword_hits(F.col("text"), _KW), intent, (F.col("conv_id") % 10) / 20.0).alias("top_k")
    )


@register(
    "caption_trigger",
    f"""SELECT conv_id, turn, conv_id % 6 = 0 OR greatest(least(({_KW_SQL}) * 0.3, 1.0), CASE WHEN contains(text, 'ing') AND ({_KW_SQL}) > 0 THEN 0.7 ELSE 0 END) >= 0.3 AS triggered FROM conversations""",
)
def caption_trigger(spark, sf):
    intent = F.when(F.contains("text", F.lit("ing")), "ingredient").otherwise("general")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", rules.caption_trigger(F.col("conv_id") % 6 == 0, text.keyword_hits(F.col("text"), _KW), F.lit("general"), intent).alias("triggered")
    )


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_ADM_SQL = f"""a AS (SELECT event_id, value / 490.02 AS pressure, 'P' || (user_id % 3) AS priority, {_K} * 0.45 + 512 * 0.54 <= 300 AS fits FROM events)"""


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@register(
    "admission_decision_table",
    f"""WITH {_ADM_SQL} SELECT event_id, CASE WHEN pressure > 0.95 THEN CASE priority WHEN 'P0' THEN CASE WHEN fits THEN 'critical' ELSE 'critical_p0_budget' END WHEN 'P1' THEN 'critical_p1_queued' ELSE 'critical_p2_rejected' END
      WHEN pressure > 0.90 AND priority = 'P2' THEN 'soft_stop' WHEN NOT fits THEN 'budget_exceeded' WHEN pressure > 0.90 THEN CASE WHEN priority = 'P1' THEN 'downgrade' ELSE 'admitted' END
      WHEN pressure > 0.80 THEN 'admitted_with_truncation' WHEN pressure > 0.70 THEN 'admitted_with_tighten' ELSE 'admitted' END AS reason FROM a""",
)
def admission_decision_table(spark, sf):
    fits = rules.kv_cost(_k(), F.lit(512)) <= 300
    priority = F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string"))
    return table(spark, sf, "events").select("event_id", rules.admission(F.col("value") / 490.02, priority, fits).alias("reason"))


@register(
    "token_budget",
    f"SELECT event_id, CAST(greatest({_K} * 40 // 2, 256) AS BIGINT) AS half, CAST(greatest({_K} * 40 // 4, 256) AS BIGINT) AS quarter, least(8.0, 0.5 * pow(2.0, event_id % 6)) AS delay FROM events",
)
def token_budget(spark, sf):
    n = _k() * 40
    return table(spark, sf, "events").select(
        "event_id",
        rules.truncation_tokens(n, 2).alias("half"),
        rules.truncation_tokens(n, 4).alias("quarter"),
        rules.backoff_seconds(F.col("event_id") % 6 + 1).alias("delay"),
    )


# --- experiments -----------------------------------------------------------

_BUCKET_SQL = """b AS (SELECT *, md5(CAST(user_id AS VARCHAR) || ':exp1') AS h FROM {rel}),
bk AS (SELECT * EXCLUDE (h), (((((('0x' || h[1:8])::BIGINT % 10000) * 7296 + ('0x' || h[9:16])::BIGINT) % 10000) * 7296 + ('0x' || h[17:24])::BIGINT) % 10000 * 7296 + ('0x' || h[25:32])::BIGINT) % 10000 AS bucket FROM b)"""


def _bucket():
    return ids.md5_bucket(F.concat(F.col("user_id").cast("string"), F.lit(":exp1")))


def _variant(bucket):
    return F.when(bucket < 5000, "control").when(bucket < 9000, "treatment").otherwise("holdout")


_VARIANT_SQL = "CASE WHEN bucket < 5000 THEN 'control' WHEN bucket < 9000 THEN 'treatment' ELSE 'holdout' END"


@register(
    "ab_assignment",
    f"WITH u AS (SELECT DISTINCT user_id FROM events), {_BUCKET_SQL.format(rel='u')} SELECT user_id, bucket, {_VARIANT_SQL} AS variant FROM bk",
)
def ab_assignment(spark, sf):
    """Traffic is split by running sums of ratios: .5, .9, 1."""
    return table(spark, sf, "events").select("user_id").distinct().withColumn("bucket", _bucket()).withColumn("variant", _variant(F.col("bucket")))


@register(
    "ab_stats",
    f"""WITH {_BUCKET_SQL.format(rel='events')} SELECT {_VARIANT_SQL} AS variant, event_type AS metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS n FROM bk GROUP BY ALL""",
)
def ab_stats(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(_variant(_bucket()).alias("variant"), F.col("event_type").alias("metric"))
        .agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"), F.count(F.lit(1)).alias("n"))
    )


_CDF = "(1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"


@register(
    "ab_z_test",
    f"""WITH {_BUCKET_SQL.format(rel='events')}, s AS (SELECT {_VARIANT_SQL} AS v, event_type AS metric, avg(value) AS m, var_pop(value) AS var, count(*) AS n FROM bk GROUP BY ALL),
    z AS (SELECT a.metric, (a.m - b.m) / sqrt(a.var / a.n + b.var / b.n) AS z, a.m < b.m AS lower FROM s a JOIN s b USING (metric) WHERE a.v = 'control' AND b.v = 'treatment' AND a.n >= 30 AND b.n >= 30),
    y AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
    p AS (SELECT *, 2 * (1 - 0.5 * (1 + sign(abs(z)) * {_CDF})) AS p FROM y)
    SELECT metric, round(z, 4) AS z, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN lower THEN 'control' ELSE 'treatment' END AS winner_lower_mean FROM p""",
)
def ab_z_test(spark, sf):
    stats = (
        table(spark, sf, "events")
        .groupBy(_variant(_bucket()).alias("variant"), F.col("event_type").alias("metric"))
        .agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count(F.lit(1)).alias("n"))
    )
    return evaluation.z_test(stats, "variant", "control", "treatment", ["metric"])


@register(
    "experiment_expiry",
    """SELECT user_id, CASE WHEN timestamp '2024-02-10' - min(ts) > interval 30 day THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY user_id""",
)
def experiment_expiry(spark, sf):
    """The reference time is an argument; there is no wall clock in a plan."""
    as_of = F.lit("2024-02-10").cast("timestamp")
    started = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("started"))
    return started.select("user_id", F.when(as_of - F.col("started") > F.expr("interval 30 days"), "completed").otherwise("running").alias("status"))


# --- request logs ----------------------------------------------------------


@register(
    "request_metrics_rollup",
    """SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events
    GROUP BY GROUPING SETS ((event_type, date_trunc('day', ts)), (event_type), ())""",
)
def request_metrics_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return e.rollup("event_type", "day").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean")
    )


@register(
    "metric_ratios",
    """SELECT user_id, count(*) AS n, round(count_if(event_type = 'error') / greatest(count(*), 1), 6) AS error_rate,
      round(count_if(event_type = 'purchase') / nullif(count_if(event_type = 'view'), 0), 6) AS purchase_per_view FROM events GROUP BY user_id""",
)
def metric_ratios(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.count_if(F.col("event_type") == "error") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("error_rate"),
        F.round(F.try_divide(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")), 6).alias("purchase_per_view"),
    )


@register(
    "latency_percentiles_linear",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
      round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def latency_percentiles_linear(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), *evaluation.linear_percentiles(F.col("value"))
    )


@register(
    "latency_percentiles_floor",
    """SELECT event_type, count(*) AS n, round(max(value), 2) AS max, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1], 2) AS p50,
      round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 2) AS p95,
      round(list_sort(list(value))[least(CAST(floor(count(*) * 0.99) AS BIGINT), count(*) - 1) + 1], 2) AS p99 FROM events GROUP BY event_type""",
)
def latency_percentiles_floor(spark, sf):
    return evaluation.floor_percentiles(table(spark, sf, "events"), ["event_type"], "value").withColumn("n", F.col("n").cast("long"))


@register(
    "qps_and_status",
    """SELECT user_id, count(*) AS total, count_if(event_type = 'error') AS failed, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS qps,
      CASE WHEN count_if(event_type <> 'error') = 0 THEN 'BLOCKED' WHEN count_if(event_type = 'error') > 0 THEN 'PARTIAL' ELSE 'EXECUTED' END AS status FROM events GROUP BY user_id""",
)
def qps_and_status(spark, sf):
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000
    failed = F.count_if(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        failed.alias("failed"),
        F.round(F.try_divide(F.count(F.lit(1)), seconds), 9).alias("qps"),
        F.when(F.count_if(F.col("event_type") != "error") == 0, "BLOCKED").when(failed > 0, "PARTIAL").otherwise("EXECUTED").alias("status"),
    )


@register(
    "last_1000_ring",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000 GROUP BY event_type""",
)
def last_1000_ring(spark, sf):
    ring = ops.last_n(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 1000)
    return ring.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register(
    "sustained_alerts",
    """WITH f AS (SELECT *, value > 150 AS bad FROM events), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS n FROM r WHERE bad GROUP BY user_id, run HAVING floor(epoch(max(ts))) - floor(epoch(min(ts))) >= 3600""",
)
def sustained_alerts(spark, sf):
    return ops.sustained(table(spark, sf, "events"), ["user_id"], "ts", F.col("value") > 150, 3600)


@register(
    "error_rate_5m",
    """WITH w AS (SELECT time_bucket(interval 5 minute, ts) AS w, * FROM events) SELECT w AS window_start, count(*) AS n, round(count_if(event_type = 'error') / count(*), 6) AS error_rate,
      count(*) >= 3 AND count_if(event_type = 'error') / count(*) > 0.3 AS alert FROM w GROUP BY w""",
)
def error_rate_5m(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("rate")
    )
    return e.select(F.col("w.start").alias("window_start"), "n", F.round("rate", 6).alias("error_rate"), ((F.col("n") >= 3) & (F.col("rate") > 0.3)).alias("alert"))


@register(
    "error_rate_sliding",
    """WITH s AS (SELECT unnest(range(0, 10)) AS i), w AS (SELECT time_bucket(interval 30 second, ts) - i * interval 30 second AS w, event_type FROM events, s)
    SELECT w AS window_start, count(*) AS n, round(count_if(event_type = 'error') / count(*), 6) AS error_rate FROM w GROUP BY w""",
)
def error_rate_sliding(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window("ts", "5 minutes", "30 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("rate")
    )
    return e.select(F.col("w.start").alias("window_start"), "n", F.round("rate", 6).alias("error_rate"))


@register(
    "sessions_last6",
    """SELECT conv_id, count(*) AS n_rounds, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id""",
)
def sessions_last6(spark, sf):
    frame = ops.last_n(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    item = F.concat_ws(":", "role", F.length("text").cast("string"))
    return frame.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"]), ",").alias("frame"),
    )


_SESSION_SQL = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval {gap} THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)"""


@register(
    "session_windows",
    f"WITH {_SESSION_SQL.format(gap='2 hour')} SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, sid",
)
def session_windows(spark, sf):
    return ops.sessions(table(spark, sf, "events"), "user_id", "ts", "2 hours").drop("w")


@register(
    "cache_ttl_replay",
    """SELECT user_id, count_if(hit) AS hits, count_if(NOT hit) AS misses, round(count_if(hit) / count(*), 4) AS hit_rate FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= interval 3600 second, false) AS hit FROM events) GROUP BY user_id""",
)
def cache_ttl_replay(spark, sf):
    r = ops.cache_replay(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 3600)
    return r.groupBy("user_id").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate")
    )


@register(
    "kv_pressure",
    f"""SELECT event_id, round(sum({_K} * 0.45 + 512 * 0.54) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id ROWS 15 PRECEDING) / 6000, 6) AS pressure FROM events""",
)
def kv_pressure(spark, sf):
    e = table(spark, sf, "events").withColumn("node", F.col("user_id") % 8)
    return ops.running_pressure(e, ["ts", "event_id"], rules.kv_cost(_k(), F.lit(512)), 6000.0, 16).select("event_id", "pressure")


@register(
    "audit_range",
    """SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= timestamp '2024-01-05' AND ts < timestamp '2024-01-20' AND event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100""",
)
def audit_range(spark, sf):
    """The newest hundred of a range: the limit is the feature."""
    e = table(spark, sf, "events").where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type in ('error', 'signup')")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "user_id", "event_type")


@register(
    "audit_redaction",
    """SELECT event_id, CASE WHEN event_type IN ('error') THEN '[REDACTED]' ELSE sha256(lower(trim(props)))[1:16] END AS query, '[REDACTED]' AS token, event_type AS kind FROM events""",
)
def audit_redaction(spark, sf):
    m = redaction.redact_map(F.create_map(F.lit("api_key"), F.col("props"), F.lit("kind"), F.col("event_type")))
    business = F.when(F.col("event_type") == "error", "development").otherwise("general")
    return table(spark, sf, "events").select(
        "event_id", redaction.redact_query(F.col("props"), business).alias("query"), m["api_key"].alias("token"), m["kind"].alias("kind")
    )


@register(
    "query_hash",
    r"""SELECT conv_id, turn, sha256(lower(translate(trim(regexp_replace(text, '\s+', ' ', 'g')), '？！。，、；：', '?!.,,;:')))[1:16] AS query_hash FROM conversations""",
)
def query_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", redaction.query_hash(F.col("text")).alias("query_hash"))


@register(
    "prometheus_text",
    """SELECT event_type, 'requests_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
)
def prometheus_text(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", F.format_string('requests_total{type="%s"} %d', "event_type", "n").alias("line")
    )


@register("token_bucket")
def token_bucket(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ops.token_bucket(e, ["user_id"], "ts", 30)


@register("lru_replay")
def lru_replay(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ops.lru_replay(e, F.col("user_id") % 16, "user_id", "ts", 1000, 3600).groupBy("shard").agg(
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n")
    )


@register("login_limiter")
def login_limiter(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ops.sliding_limit(e, ["user_id"], "ts", 5, 3600)


@register(
    "alert_rules_merged",
    """WITH d AS (SELECT event_type AS name, count(*) AS threshold FROM events GROUP BY event_type),
    c AS (SELECT event_type AS name, 2 * count(*) AS threshold FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type UNION ALL SELECT lang, count(*) FROM documents GROUP BY lang)
    SELECT coalesce(c.name, d.name) AS name, coalesce(c.threshold, d.threshold) AS threshold FROM d FULL JOIN c ON d.name = c.name""",
)
def alert_rules_merged(spark, sf):
    """Thresholds of all event types, with those of some in their place and rules for languages beside them."""
    by_type = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("threshold"))
    by_language = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("custom"))
    custom = by_type.where(F.col("name").isin("view", "click")).select("name", (2 * F.col("threshold")).alias("custom")).unionByName(by_language)
    return by_type.join(custom, "name", "full_outer").select("name", F.coalesce("custom", "threshold").alias("threshold"))
