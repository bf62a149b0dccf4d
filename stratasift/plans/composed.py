"""Composed plans and the remaining operators: prompts, variants, evidence locks, generators and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import access, text, vectors
from stratasift.operators import extension, fusion, lexical, ops

from .catalog import register
from .fixtures import GOLD_SQL, MASKED_SQL, gold_pairs, table, with_masks
from .retrieval_eval import PATHS_SQL, _paths, _top, ranked_sql


@register(
    "path_enablement",
    f"""WITH {PATHS_SQL}, cfg AS (SELECT item_id AS query, 'bm25_es' AS path, 20 AS top_k FROM benchmark UNION ALL SELECT item_id, 'rewrite_variants', 10 FROM benchmark WHERE item_id % 2 = 1)
    SELECT p.path, p.query, p.doc, p.rank FROM paths p JOIN cfg USING (query, path) WHERE p.rank <= cfg.top_k""",
)
def path_enablement(spark, sf):
    """Each query has its own paths and depths; what is not configured is pruned by the join."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    on = q.select("query", F.lit("bm25_es").alias("path"), F.lit(20).alias("top_k")).unionByName(
        q.where("query % 2 = 1").select("query", F.lit("rewrite_variants").alias("path"), F.lit(10).alias("top_k"))
    )
    return _paths(spark, sf).join(on, ["query", "path"]).where("rank <= top_k").select("path", "query", "doc", "rank")


@register(
    "variant_generation",
    r"""WITH v AS (SELECT item_id, text AS original, list_filter(list_transform(string_split(text, '. '), lambda x: trim(regexp_replace(x, '^\s*[0-9]+[.)]\s*', ''))), lambda x: x <> '' AND x <> text)[1:3] AS variants FROM benchmark)
    SELECT item_id, len(variants) AS n_variants, array_to_string(variants, '|') AS variants FROM v""",
)
def variant_generation(spark, sf):
    parts = F.transform(F.split("text", r"\. "), lambda x: F.trim(F.regexp_replace(x, r"^\s*[0-9]+[.)]\s*", "")))
    variants = F.slice(F.filter(parts, lambda x: (x != "") & (x != F.col("text"))), 1, 3)
    return table(spark, sf, "benchmark").select(
        "item_id", F.size(variants).cast("long").alias("n_variants"), F.array_join(variants, "|").alias("variants")
    )


@register(
    "evidence_lock",
    f"WITH {PATHS_SQL} SELECT query, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY rank) AS locked FROM r1 WHERE rank <= 3 GROUP BY query",
)
def evidence_lock(spark, sf):
    top = _top(spark, sf, 3)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"].cast("string"))
    return top.groupBy("query").agg(F.array_join(ordered, ",").alias("locked"))


@register(
    "candidate_rotation",
    """WITH c AS (SELECT item_id, ['a', 'b', 'c', 'd', 'e'] AS items, CAST(('0x' || sha256(CAST(item_id AS VARCHAR))[1:8])::BIGINT % 5 AS BIGINT) AS k FROM benchmark)
    SELECT item_id, array_to_string(list_concat(items[k + 1:], items[:k]), '') AS ordered FROM c""",
)
def candidate_rotation(spark, sf):
    """A pair's own digest says where its list of candidates begins."""
    items = F.array(*map(F.lit, "abcde"))
    k = (F.conv(F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 5).cast("int")
    turned = F.concat(F.slice(items, k + 1, F.lit(5)), F.slice(items, F.lit(1), k))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(turned, "").alias("ordered"))


@register(
    "json_extraction",
    r"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS parsed FROM events""",
)
def json_extraction(spark, sf):
    """The first object inside free text, parsed under a schema; what does not parse is null."""
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    parsed = F.from_json(F.regexp_extract(noisy, r"(?s)\{.*\}", 0), "k long")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNotNull().alias("parsed"))


@register(
    "prompt_assembly",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, count(*) AS n_messages, sha256('[system] ' || string_agg('[' || role || '] ' || replace(text, '<evidence>', '< evidence>'), chr(10) ORDER BY turn)) AS prompt_hash
    FROM k WHERE back <= 6 GROUP BY conv_id""",
)
def prompt_assembly(spark, sf):
    """The last six rounds as messages, with reserved markers put out of action."""
    recent = ops.last_n(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    line = F.concat(F.lit("["), "role", F.lit("] "), text.escape_markers(F.col("text"), ["<evidence>"]))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"])
    return recent.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sha2(F.concat(F.lit("[system] "), F.array_join(lines, "\n")), 256).alias("prompt_hash")
    )


@register(
    "ground_truth_resolution",
    """SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'annotations' WHEN item_id % 4 = 1 THEN 'contexts' WHEN item_id % 4 = 2 THEN 'text' ELSE 'ambiguous' END AS origin,
      CASE WHEN item_id % 4 = 0 THEN 'd' || item_id || '::c0' WHEN item_id % 4 = 1 THEN 'c' || item_id WHEN item_id % 4 = 2 THEN md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS key FROM benchmark""".replace("\\\\", "\\"),
)
def ground_truth_resolution(spark, sf):
    """Annotations come before contexts, contexts before text; several answers without either are ambiguous."""
    from stratasift.functions import ids

    i, name = F.col("item_id"), F.col("item_id").cast("string")
    rows = table(spark, sf, "benchmark").select(
        "item_id",
        "text",
        F.when(i % 4 == 0, ids.relevance_key(F.concat(F.lit("d"), name), F.lit("c0"))).alias("annotated"),
        F.when(i % 4 == 1, F.concat(F.lit("c"), name)).alias("context"),
        (i % 4 == 3).alias("several"),
    )
    origin = (
        F.when(F.col("annotated").isNotNull(), "annotations")
        .when(F.col("context").isNotNull(), "contexts")
        .when(~F.col("several"), "text")
        .otherwise("ambiguous")
    )
    key = F.coalesce("annotated", "context", F.when(~F.col("several"), F.md5(text.normalize_passage(F.col("text")))))
    return rows.select("item_id", origin.alias("origin"), key.alias("key"))


@register(
    "selector_resolution",
    """WITH s AS (SELECT item_id, substr(text, 1, 30) AS needle FROM benchmark), m AS (SELECT s.item_id, count(d.doc_id) AS n, min(d.doc_id) AS doc_id FROM s LEFT JOIN documents d ON contains(d.text, needle) GROUP BY s.item_id)
    SELECT item_id, n, CASE WHEN n = 1 THEN doc_id END AS doc_id, CASE WHEN n = 1 THEN 'resolved' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status FROM m""",
)
def selector_resolution(spark, sf):
    """A selector must match exactly one document."""
    s = table(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 30).alias("needle"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    hits = lexical.containing(d, s, "doc_id", "text", "needle").groupBy("item_id").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("one"))
    n = F.coalesce("k", F.lit(0))
    return s.join(hits, "item_id", "left").select(
        "item_id",
        n.alias("n"),
        F.when(n == 1, F.col("one")).alias("doc_id"),
        F.when(n == 1, "resolved").when(n == 0, "missing").otherwise("ambiguous").alias("status"),
    )


@register(
    "recompute_compare",
    f"""WITH {PATHS_SQL}, {GOLD_SQL}, a AS (SELECT g.item_id, count_if(r1.rank <= 10) / count(*) AS recall FROM gold g LEFT JOIN r1 ON r1.query = g.item_id AND r1.doc = g.doc_id GROUP BY g.item_id)
    SELECT 'recall_10' AS metric, round(avg(recall), 6) AS recomputed, 1.0::DOUBLE AS published, abs(avg(recall) - 1.0) <= 0.05 AS agrees FROM a""",
)
def recompute_compare(spark, sf):
    gold = gold_pairs(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    per = gold.join(_top(spark, sf, 10), ["query", "doc"], "left").groupBy("query").agg(
        (F.count("rank") / F.count(F.lit(1))).alias("recall")
    )
    mean = F.avg("recall")
    return per.agg(F.round(mean, 6).alias("recomputed"), (F.abs(mean - 1.0) <= 0.05).alias("agrees")).select(
        F.lit("recall_10").alias("metric"), "recomputed", F.lit(1.0).alias("published"), "agrees"
    )


@register(
    "caption_enrichment",
    """SELECT p.page_id, p.url, c.label FROM pages p LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0) c ON p.page_id = c.vec_id""",
)
def caption_enrichment(spark, sf):
    captions = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("page_id"), "label")
    return table(spark, sf, "pages").select("page_id", "url").join(captions, "page_id", "left")


@register(
    "batch_statistics",
    """WITH b AS (SELECT time_bucket(interval 10 minute, ts) AS b, value FROM events) SELECT count(*) AS n_batches, round(avg(least(n, 64) / 64.0), 6) AS fill_rate, round(max(d), 4) AS longest_delay
    FROM (SELECT b, count(*) AS n, max(value) AS d FROM b GROUP BY b)""",
)
def batch_statistics(spark, sf):
    """Micro-batches that close after ten minutes or 64 requests."""
    b = table(spark, sf, "events").groupBy(F.window("ts", "10 minutes")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("d"))
    return b.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.round(F.avg(F.least("n", F.lit(64)) / 64.0), 6).alias("fill_rate"),
        F.round(F.max("d"), 4).alias("longest_delay"),
    )


@register(
    "run_summary",
    """SELECT event_type AS config, count_if(value > 20) AS executed, count_if(value <= 20) AS blocked, round(count_if(value > 20) / count(*), 6) AS completion, round(quantile_cont(value, 0.5) FILTER (value > 20), 6) AS p50 FROM events GROUP BY event_type""",
)
def run_summary(spark, sf):
    done = F.col("value") > 20
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("config")).agg(
        F.count_if(done).alias("executed"),
        F.count_if(~done).alias("blocked"),
        F.round(F.count_if(done) / F.count(F.lit(1)), 6).alias("completion"),
        F.round(F.percentile(F.when(done, F.col("value")), 0.5), 6).alias("p50"),
    )


@register(
    "checklist_summary",
    "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE 'pending' END AS status, count(*) AS n FROM labels GROUP BY 1",
)
def checklist_summary(spark, sf):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("toxic") == 1, "rejected").otherwise("pending")
    return table(spark, sf, "labels").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "stale_points",
    f"WITH {MASKED_SQL} SELECT doc_id FROM masked WHERE epoch = 'e1' EXCEPT SELECT doc_id FROM masked WHERE epoch = 'e1' AND status = 'active' AND doc_id % 5 <> 0",
)
def stale_points(spark, sf):
    d = with_masks(table(spark, sf, "documents")).where("epoch = 'e1'")
    return d.select("doc_id").subtract(d.where("status = 'active' and doc_id % 5 <> 0").select("doc_id"))


@register(
    "preheated_results",
    """SELECT conv_id, turn, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS preheated FROM conversations""",
)
def preheated_results(spark, sf):
    """What the turn before left behind is used by the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag(F.md5("text")).over(w).alias("preheated"))


@register(
    "distinct_passages",
    r"""SELECT DISTINCT trim(regexp_replace(x, '\s+', ' ', 'g')) AS passage FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE trim(x) <> ''""",
)
def distinct_passages(spark, sf):
    lines = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("x")).where(F.trim("x") != "")
    return lines.select(text.normalize_passage(F.col("x")).alias("passage")).distinct()


@register(
    "hashed_embedding",
    """WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM benchmark),
    b AS (SELECT item_id, ('0x' || md5(unnest(ts))[1:8])::BIGINT % 32 AS b FROM t), c AS (SELECT item_id, b, count(*) AS c FROM b GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM c GROUP BY item_id)
    SELECT n.item_id, CAST(i AS INTEGER) AS i, round(coalesce(c.c, 0) / n.n, 6) AS x FROM n, unnest(range(0, 32)) u(i) LEFT JOIN c ON c.item_id = n.item_id AND c.b = i""".replace("\\\\", "\\"),
)
def hashed_embedding(spark, sf):
    """An embedder without a model: token counts by hash bucket, scaled to length one."""
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(vectors.hashed_bag(text.tokens(F.col("text")), 32)).alias("i", "x"))
    return rows.withColumn("x", F.round("x", 6))


@register(
    "synthetic_corpus",
    """SELECT i AS doc_no, 'REG-' || lpad(CAST(i AS VARCHAR), 5, '0') AS doc_id, ['regulation', 'ingredient', 'formula'][CAST(('0x' || md5(CAST(i AS VARCHAR))[1:6])::BIGINT % 3 + 1 AS BIGINT)] AS doc_type,
      ('0x' || md5('m' || i)[1:4])::BIGINT % 16 AS role_mask FROM (SELECT doc_id AS i FROM documents)""",
)
def synthetic_corpus(spark, sf):
    """A row for each document, whose columns follow from its number alone."""
    n = F.col("id").cast("string")
    kind = F.element_at(
        F.array(*map(F.lit, ("regulation", "ingredient", "formula"))),
        (F.conv(F.substring(F.md5(n), 1, 6), 16, 10).cast("long") % 3 + 1).cast("int"),
    )
    mask = F.conv(F.substring(F.md5(F.concat(F.lit("m"), n)), 1, 4), 16, 10).cast("long") % 16
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).select(
        F.col("id").alias("doc_no"), F.concat(F.lit("REG-"), F.lpad(n, 5, "0")).alias("doc_id"), kind.alias("doc_type"), mask.alias("role_mask")
    )


@register(
    "question_pipeline",
    f"""WITH {PATHS_SQL}, {MASKED_SQL}, fused AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS n_paths FROM paths GROUP BY query, doc),
    seen AS (SELECT f.* FROM fused f JOIN masked m ON f.doc = m.doc_id WHERE role_mask IS NOT NULL AND dept_mask IS NOT NULL AND (role_mask = 0 OR role_mask & 2 <> 0) AND (dept_mask = 0 OR dept_mask & 6 <> 0)),
    {ranked_sql('fr', 'seen', 3)}, g AS (SELECT query, max(CASE WHEN rank = 1 THEN score END) * 30 AS evidence, count(*) AS n FROM fr GROUP BY query)
    SELECT b.item_id AS query, round(coalesce(g.evidence, 0), 6) AS evidence, coalesce(g.n, 0) AS n_docs,
      CASE WHEN coalesce(round(g.evidence, 6), 0) >= 0.75 THEN 'pass' WHEN coalesce(round(g.evidence, 6), 0) >= 0.55 THEN 'enhanced_generate' ELSE 'reject' END AS decision FROM benchmark b LEFT JOIN g ON b.item_id = g.query""",
)
def question_pipeline(spark, sf):
    """Recall on several paths, fusion, permissions, top three and the gate, for all questions in one plan."""
    fused = fusion.reciprocal_rank_fusion(_paths(spark, sf), {}).drop("rank")
    ok = access.is_authorized(F.col("role_mask"), F.lit(2).cast("long"), F.col("dept_mask"), F.lit(6).cast("long"))
    visible = with_masks(table(spark, sf, "documents").select("doc_id")).where(ok).select(F.col("doc_id").alias("doc"))
    top = lexical.top_k(fused.join(visible, "doc", "left_semi"), 3)
    gate = top.groupBy("query").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) * 30).alias("e"), F.count(F.lit(1)).alias("n"))
    score = F.round(F.coalesce("e", F.lit(0.0)), 6)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query")).join(gate, "query", "left").select(
        "query",
        score.alias("evidence"),
        F.coalesce("n", F.lit(0)).alias("n_docs"),
        F.when(score >= 0.75, "pass").when(score >= 0.55, "enhanced_generate").otherwise("reject").alias("decision"),
    )


@register("admission_fold")
def admission_fold(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        "ts",
        (F.col("user_id") % 8).alias("node"),
        F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string")).alias("priority"),
        (F.col("value") * 2.0).alias("cost"),
    )
    return ops.admission_fold(e, ["node"], "ts", 6000.0, 7200)


@register(
    "pluggable_scorer",
    rf"""WITH {PATHS_SQL}, w AS (SELECT query, doc, list_distinct(list_filter(string_split_regex(b.text, '\s+'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(d.text, '\s+'), lambda x: x <> '')) AS t
      FROM r1 JOIN benchmark b ON b.item_id = r1.query JOIN documents d ON d.doc_id = r1.doc WHERE rank <= 5)
    SELECT query, doc, round(len(list_intersect(q, t)) / greatest(1, len(q)), 6) AS score FROM w""",
)
def pluggable_scorer(spark, sf):
    """A pair scorer that the caller supplies, on the top of each query only."""

    def load():
        def model(pairs):
            out = []
            for a, b in pairs:
                x, y = set(a.split()), set(b.split())
                out.append(len(x & y) / max(1, len(x)))
            return out

        return model

    top = _top(spark, sf, 5)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    pairs = top.join(docs, "doc").join(asked, "query")
    return pairs.select("query", "doc", F.round(extension.score_pairs(F.col("passage"), F.col("body"), load), 6).alias("score"))
