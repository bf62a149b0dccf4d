"""Queries over the evidence behind published figures, trust claims, batches, and retrievers by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import access
from stratasift.operators import approval, evidence, extension, lexical

from .approval import _inputs
from .approval import _SQL as _APPROVAL_SQL
from .catalog import register
from .fixtures import table
from .retrieval_eval import _EVAL_SQL, BM25, _results, ranked_sql

_MEANS = ("recall_1", "recall_3", "recall_5", "recall_10", "hit_1", "hit_3", "hit_5", "hit_10", "rr", "ndcg")
_METRICS_SQL = f"""{_EVAL_SQL}, one AS (SELECT CAST(count(*) AS DOUBLE) AS sample_count, CAST(count(recall_10) AS DOUBLE) AS scored_sample_count, {", ".join(f"avg(CAST({m} AS DOUBLE)) AS {m}" for m in _MEANS)} FROM res),
mt AS (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)"""


@register("metric_table", f"WITH {_METRICS_SQL} SELECT metric, round(value, 6) AS value FROM mt")
def metric_table(spark, sf):
    """All metrics of a run, recomputed from its results by query."""
    found = evidence.metric_table(_results(spark, sf), list(_MEANS), "recall_10")
    return found.where("value is not null").select("metric", F.round("value", 6).alias("value"))


@register(
    "metric_mismatches",
    f"""WITH {_METRICS_SQL}, pb AS (SELECT metric, CASE WHEN metric LIKE 'hit%' THEN value + 0.004 WHEN metric = 'sample_count' THEN value + 1 WHEN metric LIKE 'recall%' THEN value - 0.02 ELSE value END AS published FROM mt
      UNION ALL SELECT 'map', 0.5)
    SELECT pb.metric, round(published, 6) AS published, round(value, 6) AS recomputed, CASE WHEN value IS NULL THEN 'not_recomputed' ELSE 'differs' END AS problem FROM pb LEFT JOIN mt USING (metric)
    WHERE value IS NULL OR abs(published - value) > CASE WHEN metric IN ('sample_count', 'scored_sample_count') THEN 0 ELSE 0.01 END""",
)
def metric_mismatches(spark, sf):
    """A published table of all metrics, of which some were changed, one miscounted and one made up."""
    found = evidence.metric_table(_results(spark, sf), list(_MEANS), "recall_10")
    m = F.col("metric")
    changed = F.when(m.startswith("hit"), F.col("value") + 0.004).when(m == "sample_count", F.col("value") + 1).when(m.startswith("recall"), F.col("value") - 0.02)
    made_up = spark.range(1).select(F.lit("map").alias("metric"), F.lit(0.5).alias("value"))
    published = found.select("metric", changed.otherwise(F.col("value")).alias("value")).unionByName(made_up)
    out = evidence.metric_mismatches(published, found, 0.01)
    return out.withColumns({c: F.round(c, 6) for c in ("published", "recomputed")})


_ASSETS_SQL = """a AS (SELECT CASE WHEN doc_id % 40 <> 0 THEN 'data/' || doc_id END AS path, CASE doc_id % 5 WHEN 0 THEN 'SYNTHETIC' WHEN 1 THEN 'PUBLIC' WHEN 2 THEN 'SYNTHETIC' WHEN 3 THEN 'OTHER' ELSE 'PUBLIC' END AS class,
  CASE WHEN doc_id % 5 = 0 THEN 'data/' || (doc_id + 1) WHEN doc_id % 15 = 4 THEN 'nowhere' END AS marker FROM documents),
tr AS (SELECT 'data/' || doc_id AS path FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'more/' || doc_id FROM labels),
iv AS (SELECT 'data/' || doc_id AS path FROM documents WHERE doc_id % 11 <> 0),
w AS (SELECT * FROM a WHERE path IS NOT NULL)"""


@register(
    "manifest_problems",
    f"""WITH {_ASSETS_SQL} SELECT path, 'undeclared_class' AS problem FROM w WHERE class NOT IN ('SYNTHETIC', 'PUBLIC')
    UNION ALL SELECT path, 'missing' FROM w WHERE path NOT IN (SELECT path FROM tr)
    UNION ALL SELECT path, 'no_marker' FROM w WHERE class = 'SYNTHETIC' AND marker IS NULL
    UNION ALL SELECT path, 'marker_absent' FROM w WHERE marker IS NOT NULL AND marker NOT IN (SELECT path FROM tr)
    UNION ALL SELECT path, 'not_in_inventory' FROM w WHERE path NOT IN (SELECT path FROM iv)
    UNION ALL SELECT path, 'incomplete' FROM a WHERE path IS NULL
    UNION ALL SELECT DISTINCT path, 'undeclared' FROM tr WHERE path NOT IN (SELECT path FROM w)""",
)
def manifest_problems(spark, sf):
    """Everything that can be wrong between a manifest of data files, the files and the inventory."""
    d, docs = F.col("doc_id"), table(spark, sf, "documents").select("doc_id")

    def at(folder, number):
        return F.concat(F.lit(folder), number.cast("string"))

    assets = docs.select(
        F.when(d % 40 != 0, at("data/", d)).alias("path"),
        F.when(d % 5 == 3, "OTHER").when((d % 5 == 0) | (d % 5 == 2), "SYNTHETIC").otherwise("PUBLIC").alias("class"),
        F.when(d % 5 == 0, at("data/", d + 1)).when(d % 15 == 4, "nowhere").alias("marker"),
    )
    tracked = docs.where(d % 7 != 0).select(at("data/", d).alias("path")).unionByName(table(spark, sf, "labels").select(at("more/", d).alias("path")))
    inventory = docs.where(d % 11 != 0).select(at("data/", d).alias("path"))
    return evidence.manifest_problems(assets, tracked, ["SYNTHETIC", "PUBLIC"], inventory)


@register(
    "publication_blockers_listed",
    f"""WITH {_APPROVAL_SQL}, al AS (SELECT unnest(codes) AS code FROM vd), ct AS (SELECT code, count(*) AS n FROM al GROUP BY code),
    cf AS (SELECT lang, count(*) > 0 AS executed, count_if(source IS NULL) = 0 AND min(doc_id) % 2 = 0 AS attributable FROM documents GROUP BY lang),
    b AS (SELECT list_filter([CASE WHEN NOT bool_or(executed) THEN 'no_configuration_executed' END, CASE WHEN NOT bool_and(attributable) THEN 'dataset_not_attributable' END, 'synthetic_retriever',
      'source_approval_not_verified: ' || (SELECT coalesce(string_agg(code || '×' || n, ', ' ORDER BY code || '×' || n), 'no evidence collected') FROM ct)], lambda x: x IS NOT NULL) AS bs FROM cf)
    SELECT CAST(i - 1 AS INT) AS place, bs[i] AS blocker FROM b, unnest(range(1, len(bs) + 1)) u(i)""",
)
def publication_blockers_listed(spark, sf):
    """Why a run may not be published, with the codes of its sources."""
    chunks, ledger, files, _ = _inputs(spark, sf)
    none = table(spark, sf, "labels").limit(0).select(F.lit("").alias("chunk_id"))
    declared = chunks.agg(F.count(F.lit(1)).alias("n"))
    report = approval.approval_report(chunks, ledger, files, none, "e1", declared)
    runs = table(spark, sf, "documents").groupBy("lang").agg(
        (F.count(F.lit(1)) > 0).alias("executed"), ((F.count_if(F.col("source").isNull()) == 0) & (F.min("doc_id") % 2 == 0)).alias("attributable")
    )
    return evidence.publication_blockers(runs, F.col("attributable"), F.col("executed"), report)


@register(
    "batch_ring_statistics",
    """WITH b AS (SELECT event_type, ts, event_id, 1 + user_id % 16 AS items, CAST(event_id % 37 AS DOUBLE) AS queue_ms, CAST(user_id % 11 AS DOUBLE) AS inference_ms FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM b QUALIFY k <= 1000),
    t AS (SELECT event_type, count(*) AS n_batches, CAST(sum(items) AS BIGINT) AS n_items FROM b GROUP BY event_type),
    l AS (SELECT event_type, avg(items) AS mean_items, list(queue_ms ORDER BY queue_ms) AS q, list(queue_ms + inference_ms ORDER BY queue_ms + inference_ms) AS w, avg(CASE WHEN queue_ms + inference_ms > 0 THEN inference_ms / (queue_ms + inference_ms) END) AS busy FROM r GROUP BY event_type)
    SELECT event_type, n_batches, n_items, round(mean_items / 16, 6) AS fill_rate, q[least(CAST(floor(len(q) * 0.5) AS BIGINT), len(q) - 1) + 1] AS queue_p50, q[least(CAST(floor(len(q) * 0.99) AS BIGINT), len(q) - 1) + 1] AS queue_p99,
      w[least(CAST(floor(len(w) * 0.99) AS BIGINT), len(w) - 1) + 1] AS delay_p99, round(coalesce(busy, 0), 6) AS utilisation FROM t JOIN l USING (event_type)""",
)
def batch_ring_statistics(spark, sf):
    """Fill, waiting and use of the last thousand batches of each kind."""
    batches = table(spark, sf, "events").select(
        "event_type", "ts", "event_id", (1 + F.col("user_id") % 16).alias("items"), (F.col("event_id") % 37).cast("double").alias("queue_ms"), (F.col("user_id") % 11).cast("double").alias("inference_ms")
    )
    return evidence.batch_statistics(batches, "event_type", ["ts", "event_id"], 16)


@register(
    "trust_claims",
    """WITH p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)
    SELECT doc_id, CASE WHEN path LIKE 'src1%' THEN 'UNTRUSTED' WHEN path LIKE '%/fr/%' OR path LIKE '%/de/%7.txt' THEN 'MANAGED_INTERNAL' ELSE 'UNTRUSTED' END AS claim FROM p""",
)
def trust_claims(spark, sf):
    """What the first fitting rule says of a source's trust."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    rules = [("src1*", "UNTRUSTED"), ("", "MANAGED_INTERNAL"), ("*/fr/*", "MANAGED_INTERNAL"), ("/*/de/*7.txt", "MANAGED_INTERNAL")]
    return table(spark, sf, "documents").select("doc_id", evidence.trust_claim(path, rules, "UNTRUSTED").alias("claim"))


@register("retriever_by_name", f"WITH {BM25}, {ranked_sql('r', 'scored', 12)} SELECT query, doc, score, rank FROM r")
def retriever_by_name(spark, sf):
    """A retriever of the registry, at a depth that may be compared."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return extension.retrieve("bm25", docs, table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text"), 12)


_VARIANTS_SQL = r"""vr AS (SELECT item_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(regexp_replace(x, '^\s*[0-9]+[.)]\s*', ''))), lambda x: x <> '' AND x <> text)[1:3] AS vs FROM benchmark),
vq AS (SELECT item_id * 10 + i AS item_id, vs[i] AS text FROM vr, unnest(range(1, len(vs) + 1)) u(i))"""


@register(
    "variant_recall",
    f"""WITH {_VARIANTS_SQL}, {lexical.bm25_sql('documents', 'vq')}, {ranked_sql('r', 'scored', 10)},
    b AS (SELECT query // 10 AS query, doc, max(score) AS score, count(*) AS n_variants FROM r GROUP BY ALL) SELECT query, doc, score, n_variants FROM b""",
)
def variant_recall(spark, sf):
    """Each variant of a question recalls a third of the depth; a document counts with its best variant."""
    parts = F.transform(F.split("text", r"\. "), lambda x: F.trim(F.regexp_replace(x, r"^\s*[0-9]+[.)]\s*", "")))
    variants = F.slice(F.filter(parts, lambda x: (x != "") & (x != F.col("text"))), 1, 3)
    asked = table(spark, sf, "benchmark").select("item_id", F.posexplode(variants).alias("nth", "text"))
    asked = asked.select(F.struct("item_id", "nth").alias("asked"), "text")
    found = lexical.top_k(lexical.bm25_top_k(table(spark, sf, "documents"), asked, 30 // 3, "doc_id", "asked"), 30 // 3)
    return found.groupBy(F.col("query.item_id").alias("query"), "doc").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_variants"))


@register(
    "identifier_validators",
    r"""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 'doc ' || doc_id WHEN 2 THEN '../up' WHEN 3 THEN '/abs' WHEN 4 THEN 'a/../b' ELSE '' END AS name FROM documents)
    SELECT doc_id, regexp_full_match(name, '[A-Za-z0-9_-]+') AS valid_id, NOT starts_with(name, '/') AND NOT list_contains(string_split(name, '/'), '..') AS inside, regexp_full_match('v' || (doc_id % 6), '[A-Za-z0-9_-]+') AS valid_epoch FROM c""",
)
def identifier_validators(spark, sf):
    """Document ids, epochs, and paths that must not leave their root."""
    d = F.col("doc_id")
    name = F.lit("")
    for i, c in ((4, F.lit("a/../b")), (3, F.lit("/abs")), (2, F.lit("../up")), (1, F.concat(F.lit("doc "), d.cast("string"))), (0, F.concat(F.lit("doc-"), d.cast("string")))):
        name = F.when(d % 6 == i, c).otherwise(name)
    epoch = F.concat(F.lit("v"), (d % 6).cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", access.valid_identifier(name).alias("valid_id"), access.inside_root(name).alias("inside"), access.valid_identifier(epoch).alias("valid_epoch")
    )
