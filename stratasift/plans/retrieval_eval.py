"""Queries over retrieval, fusion and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import access, vectors
from stratasift.operators import dense, evaluation, fusion, lexical
from stratasift.staging import stage

from .catalog import register
from .fixtures import GOLD_SQL, MASKED_SQL, gold_pairs, table, with_masks

BM25 = lexical.bm25_sql("documents", "benchmark")
#: The first half of each passage: a harder query.
HALF_SQL = "half AS (SELECT item_id, substr(text, 1, length(text) // 2) AS text FROM benchmark)"
BM25_HALF = lexical.bm25_sql("documents", "half", prefix="h")


def ranked_sql(name: str, scored: str, k: int) -> str:
    return f"""{name} AS (SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank
  FROM {scored}) WHERE rank <= {k})"""


def _top(spark, sf, k):
    return lexical.top_k(lexical.bm25_top_k(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k, "doc_id", "item_id"), k)


def _top_paths(spark, sf, k):
    """(path, query, doc, score, rank): whole passages and their first halves, from one build."""
    items = table(spark, sf, "benchmark")
    half = F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))

    def asked(path, words):
        return items.select(F.struct(F.lit(path).alias("path"), "item_id").alias("asked"), words.alias("text"))

    both = asked("bm25_es", F.col("text")).unionByName(asked("rewrite_variants", half))
    scored = lexical.bm25_top_k(table(spark, sf, "documents"), both, k, "doc_id", "asked")
    found = lexical.top_k(scored.select("query.path", F.col("query.item_id").alias("query"), "doc", "score"), k, ["path", "query"])
    # Most plans use the lists several times.
    return stage(found, "paths")


@register("bm25_top10", f"WITH {BM25}, {ranked_sql('r', 'scored', 10)} SELECT query, doc, score, rank FROM r")
def bm25_top10(spark, sf):
    return _top(spark, sf, 10)


@register(
    "bm25_idf_table",
    f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st WHERE term IN (SELECT term FROM qt)",
)
def bm25_idf_table(spark, sf):
    docs = lexical.document_terms(table(spark, sf, "documents"), "doc_id", "text")
    asked = lexical.query_terms(table(spark, sf, "benchmark"), "item_id", "text").select("term").distinct()
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = (
        docs.select(F.explode(F.array_distinct("terms")).alias("term"))
        .join(asked, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_ALLOWED_SQL = "role_mask IS NOT NULL AND dept_mask IS NOT NULL AND (role_mask = 0 OR role_mask & 2 <> 0) AND (dept_mask = 0 OR dept_mask & 6 <> 0)"


@register(
    "bm25_rbac_top10",
    f"""WITH {BM25}, {MASKED_SQL}, seen AS (SELECT s.* FROM scored s JOIN masked m ON s.doc = m.doc_id WHERE status = 'active' AND {_ALLOWED_SQL}),
    {ranked_sql('r', 'seen', 10)} SELECT query, doc, score, rank FROM r""",
)
def bm25_rbac_top10(spark, sf):
    """Permissions and status filter the candidates before the top is taken; the statistics are those of all documents."""
    allowed = access.is_authorized(F.col("role_mask"), F.lit(2).cast("long"), F.col("dept_mask"), F.lit(6).cast("long"))
    docs = with_masks(table(spark, sf, "documents"))
    visible = (F.col("status") == "active") & allowed
    found = lexical.bm25_top_k(docs, table(spark, sf, "benchmark"), 10, "doc_id", "item_id", visible=visible)
    return lexical.top_k(found, 10).select("query", "doc", "score", "rank")


@register(
    "bm25_post_filter_top10",
    f"""WITH {BM25}, {MASKED_SQL}, {ranked_sql('r', 'scored', 10)}
    SELECT r.query, r.doc, r.score, r.rank FROM r JOIN masked m ON r.doc = m.doc_id WHERE status = 'active' AND {_ALLOWED_SQL}""",
)
def bm25_post_filter_top10(spark, sf):
    """The top first, permissions after: fewer rows where many are forbidden."""
    allowed = access.is_authorized(F.col("role_mask"), F.lit(2).cast("long"), F.col("dept_mask"), F.lit(6).cast("long"))
    visible = with_masks(table(spark, sf, "documents").select("doc_id")).where((F.col("status") == "active") & allowed)
    top = _top(spark, sf, 10)
    return top.join(visible.select(F.col("doc_id").alias("doc")), "doc", "left_semi").select("query", "doc", "score", "rank")


_PAIRS = [("the", "of"), ("was", "that"), ("der", "die"), ("que", "para"), ("les", "une")]
_PAIRS_SQL = "pairs(l, r) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + ")"


@register(
    "term_pair_cooccurrence",
    f"WITH {_PAIRS_SQL} SELECT l AS left_term, r AS right_term, count(d.doc_id) AS n_docs FROM pairs LEFT JOIN documents d ON contains(d.text, l) AND contains(d.text, r) GROUP BY l, r",
)
def term_pair_cooccurrence(spark, sf):
    """A stated list of pairs becomes columns of one scan."""
    d = table(spark, sf, "documents")
    both = [F.count_if(F.contains("text", F.lit(a)) & F.contains("text", F.lit(b))).alias(f"p{i}") for i, (a, b) in enumerate(_PAIRS)]
    rows = d.agg(*both).select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("left_term"), F.lit(b).alias("right_term"), F.col(f"p{i}").alias("n_docs")) for i, (a, b) in enumerate(_PAIRS)])
        ).alias("x")
    )
    return rows.select("x.*")


def _paths(spark, sf, k=50):
    return _top_paths(spark, sf, k).select("path", "query", "doc", "rank")


PATHS_SQL = f"""{BM25}, {HALF_SQL}, {BM25_HALF}, {ranked_sql('r1', 'scored', 50)}, {ranked_sql('r2', 'hscored', 50)},
paths AS (SELECT 'bm25_es' AS path, query, doc, rank FROM r1 UNION ALL SELECT 'rewrite_variants', query, doc, rank FROM r2)"""


def _rrf_sql(weight: str) -> str:
    return f"""fused AS (SELECT query, doc, round(sum({weight} / (60 + rank)), 9) AS score, count(*) AS n_paths FROM paths GROUP BY query, doc),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, n_paths DESC, doc) AS rank FROM fused)"""


@register("rrf_two_path", f"WITH {PATHS_SQL}, {_rrf_sql('1.0')} SELECT query, doc, score, n_paths, rank FROM ordered WHERE rank <= 10")
def rrf_two_path(spark, sf):
    return fusion.reciprocal_rank_fusion(_paths(spark, sf), {}).where("rank <= 10")


_REG = "CASE WHEN path = 'bm25_es' THEN 1.5 ELSE 1.0 END"


@register("rrf_weighted_regulation", f"WITH {PATHS_SQL}, {_rrf_sql(_REG)} SELECT query, doc, score, n_paths, rank FROM ordered WHERE rank <= 10")
def rrf_weighted_regulation(spark, sf):
    return fusion.reciprocal_rank_fusion(_paths(spark, sf), fusion.query_weights(True, False)).where("rank <= 10")


@register(
    "path_jaccard_agreement",
    f"""WITH {PATHS_SQL}, t AS (SELECT query, path, list(DISTINCT doc) AS docs FROM paths WHERE rank <= 10 GROUP BY query, path)
    SELECT a.query, round(len(list_intersect(a.docs, b.docs)) / len(list_distinct(list_concat(a.docs, b.docs))), 6) AS agreement
    FROM t a JOIN t b ON a.query = b.query AND a.path < b.path""",
)
def path_jaccard_agreement(spark, sf):
    return fusion.path_agreement(_paths(spark, sf))


@register("agreement_clustered")
def agreement_clustered(spark, sf):
    """0.7 of the concentration over hash clusters and 0.3 of the paths' agreement."""
    paths = _paths(spark, sf, 10)
    both = fusion.rank_entropy(paths).join(fusion.path_agreement(paths), "query", "left")
    return both.select("query", F.round(0.7 * F.col("concentration") + 0.3 * F.coalesce("agreement", F.lit(0.0)), 6).alias("agreement"))


@register(
    "union_dedup",
    f"""WITH {PATHS_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY CASE path WHEN 'rewrite_variants' THEN 1 ELSE 2 END, rank) AS n FROM paths)
    SELECT path, query, doc, rank FROM u WHERE n = 1""",
)
def union_dedup(spark, sf):
    return fusion.union_first_wins(_paths(spark, sf), ["rewrite_variants", "bm25_es"])


@register(
    "fallback_recall",
    f"""WITH {PATHS_SQL}, few AS (SELECT query, doc, rank FROM r2 WHERE rank <= 5), n AS (SELECT query, count(*) AS n, max(rank) AS last FROM few GROUP BY query),
    extra AS (SELECT r1.query, r1.doc, coalesce(last, 0) + row_number() OVER (PARTITION BY r1.query ORDER BY r1.rank, r1.doc) AS rank
      FROM r1 LEFT JOIN n ON r1.query = n.query WHERE coalesce(n.n, 0) < 50 AND NOT EXISTS (SELECT 1 FROM few WHERE few.query = r1.query AND few.doc = r1.doc))
    SELECT query, doc, rank, 'fused' AS origin FROM few UNION ALL SELECT query, doc, rank, 'fallback' FROM extra""",
)
def fallback_recall(spark, sf):
    top = _top_paths(spark, sf, 50)
    few = top.where("path = 'rewrite_variants' and rank <= 5")
    return fusion.with_fallback(few, top.where("path = 'bm25_es'"))


@register(
    "path_contribution",
    f"""WITH {PATHS_SQL}, {_rrf_sql('1.0')}, top AS (SELECT query, doc FROM ordered WHERE rank <= 10)
    SELECT p.path, round(count(*) / (SELECT count(*) FROM top), 6) AS share FROM top JOIN paths p USING (query, doc) GROUP BY p.path""",
)
def path_contribution(spark, sf):
    paths = _paths(spark, sf)
    top = fusion.reciprocal_rank_fusion(paths, {}).where("rank <= 10").select("query", "doc")
    n = top.agg(F.count(F.lit(1)).alias("n"))
    return (
        top.join(paths, ["query", "doc"])
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("k"))
        .crossJoin(F.broadcast(n))
        .select("path", F.round(F.col("k") / F.col("n"), 6).alias("share"))
    )


# --- dense -----------------------------------------------------------------

_DENSE_SQL = """q AS (SELECT vec_id AS query, embedding AS q, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
dscored AS (SELECT query, vec_id AS doc, label, ql, round(list_inner_product(list_transform(q, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))) /
  (sqrt(list_inner_product(list_transform(q, lambda x: CAST(x AS DOUBLE)), list_transform(q, lambda x: CAST(x AS DOUBLE)))) *
   sqrt(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))))), 6) AS score
  FROM embeddings, q WHERE vec_id <> query)"""


def _dense(spark, sf, k, measure=dense.COSINE, owner=None):
    """Every vector whose id is divisible by 20 asks all others."""
    e = table(spark, sf, "embeddings")
    corpus = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    return dense.similarity_top_k(corpus, corpus.where("doc % 20 = 0").withColumnRenamed("doc", "query"), k, measure, owner)


@register("cosine_top10", f"WITH {_DENSE_SQL}, {ranked_sql('r', 'dscored', 10)} SELECT query, doc, score, rank FROM r")
def cosine_top10(spark, sf):
    return _dense(spark, sf, 10)


_DAMPED_SQL = _DENSE_SQL.replace(")))), 6) AS score", "))) + 1e-8), 6) AS score")


@register("biencoder_top150", f"WITH {_DAMPED_SQL}, {ranked_sql('r', 'dscored', 150)} SELECT query, doc, score, rank FROM r")
def biencoder_top150(spark, sf):
    return _dense(spark, sf, 150, dense.Measure(damping=1e-8))


@register(
    "distinct_doc_topk",
    f"""WITH {_DENSE_SQL}, best AS (SELECT query, label AS doc, max(score) AS score FROM dscored GROUP BY query, label), {ranked_sql('r', 'best', 5)}
    SELECT query, doc, score, rank FROM r""",
)
def distinct_doc_topk(spark, sf):
    """The best vector of each document (here: label) first, then the top."""
    return _dense(spark, sf, 5, owner="label")


@register(
    "centroid",
    """WITH s AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY label, i),
    n AS (SELECT label, sqrt(sum(m * m)) AS n FROM s GROUP BY label)
    SELECT s.label, CAST(i - 1 AS INTEGER) AS i, round(m / n, 6) AS x FROM s JOIN n USING (label)""",
)
def centroid(spark, sf):
    c = dense.centroid(table(spark, sf, "embeddings"), "embedding", ["label"])
    return c.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@register(
    "vector_validation",
    """WITH v AS (SELECT label, CASE WHEN vec_id % 11 = 0 THEN embedding[1:63] WHEN vec_id % 13 = 0 THEN list_append(embedding[1:63], NULL) WHEN vec_id % 17 = 0 THEN list_append(embedding[1:63], CAST('nan' AS FLOAT))
      WHEN vec_id % 19 = 0 THEN list_append(embedding[1:63], CAST('inf' AS FLOAT)) WHEN vec_id % 23 = 0 THEN NULL ELSE embedding END AS e FROM embeddings)
    SELECT label, count(*) AS n, count_if(len(e) = 64) AS n_dim, count_if(e IS NULL OR len(e) <> 64 OR len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) < 64) AS n_invalid FROM v GROUP BY label""",
)
def vector_validation(spark, sf):
    """Vectors of the wrong length, without a value, not finite or missing, planted among good ones."""
    v, cut = F.col("vec_id"), F.slice("embedding", 1, 63)

    def ending(value):
        return F.concat(cut, F.array(F.lit(value).cast("float")))

    planted = (
        F.when(v % 11 == 0, cut)
        .when(v % 13 == 0, ending(None))
        .when(v % 17 == 0, ending(float("nan")))
        .when(v % 19 == 0, ending(float("inf")))
        .when(v % 23 == 0, None)
        .otherwise(F.col("embedding"))
    )
    return (
        table(spark, sf, "embeddings")
        .select("label", planted.alias("e"))
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.coalesce(F.size("e") == 64, F.lit(False))).alias("n_dim"),
            F.count_if(~vectors.valid_vector(F.col("e"), 64)).alias("n_invalid"),
        )
    )


@register(
    "platt_rerank_top10",
    f"""WITH {_DENSE_SQL}, p AS (SELECT query, doc, round(1 / (1 + exp(score)), 6) AS score FROM dscored), {ranked_sql('r', 'p', 10)} SELECT query, doc, score, rank FROM r""",
)
def platt_rerank_top10(spark, sf):
    """Calibration with the parameters -1 and 0 turns the order round; the engine's own default is +1."""
    return _dense(spark, sf, 10, dense.Measure(platt=(-1.0, 0.0)))


# --- evaluation ------------------------------------------------------------

_EVAL_SQL = f"""{BM25}, {ranked_sql('r', 'scored', 10)}, {GOLD_SQL},
gi AS (SELECT item_id, doc_id, grade, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS ideal FROM gold),
per AS (SELECT item_id, count(*) AS n_gold,
  count_if(rank <= 1) / count(*) AS recall_1, count_if(rank <= 3) / count(*) AS recall_3, count_if(rank <= 5) / count(*) AS recall_5, count_if(rank <= 10) / count(*) AS recall_10,
  coalesce(bool_or(rank <= 1), false) AS hit_1, coalesce(bool_or(rank <= 3), false) AS hit_3, coalesce(bool_or(rank <= 5), false) AS hit_5, coalesce(bool_or(rank <= 10), false) AS hit_10,
  coalesce(max(1 / rank), 0) AS rr,
  round(coalesce(sum(grade / log2(rank + 1)), 0) / sum(CASE WHEN ideal <= 10 THEN grade / log2(ideal + 1) END), 6) AS ndcg
  FROM gi LEFT JOIN r ON r.query = gi.item_id AND r.doc = gi.doc_id GROUP BY item_id),
res AS (SELECT b.item_id AS query, CASE WHEN b.item_id % 2 = 0 THEN 'regulation' ELSE 'ingredient' END AS business_type,
  CASE WHEN length(b.text) < 250 THEN 'easy' ELSE 'hard' END AS difficulty, per.* EXCLUDE (item_id) FROM benchmark b LEFT JOIN per ON b.item_id = per.item_id)"""


def _results(spark, sf):
    gold = gold_pairs(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"), "grade")
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query"),
        F.when(F.col("item_id") % 2 == 0, "regulation").otherwise("ingredient").alias("business_type"),
        F.when(F.length("text") < 250, "easy").otherwise("hard").alias("difficulty"),
    )
    return evaluation.score_rankings(gold, _top(spark, sf, 10), queries)


@register(
    "recall_hit_at_k",
    f"WITH {_EVAL_SQL} SELECT query, n_gold, recall_1, recall_3, recall_5, recall_10, hit_1, hit_3, hit_5, hit_10 FROM res",
)
def recall_hit_at_k(spark, sf):
    return _results(spark, sf).select(
        "query", "n_gold", *[f"recall_{k}" for k in evaluation.DEPTHS], *[f"hit_{k}" for k in evaluation.DEPTHS]
    )


@register("mrr_at_10", f"WITH {_EVAL_SQL} SELECT query, rr FROM res")
def mrr_at_10(spark, sf):
    return _results(spark, sf).select("query", "rr")


@register("ndcg_graded_10", f"WITH {_EVAL_SQL} SELECT query, ndcg FROM res")
def ndcg_graded_10(spark, sf):
    return _results(spark, sf).select("query", "ndcg")


_BLOCK_SQL = ", ".join(
    ["count(*) AS n_queries", "count(n_gold) AS n_scored"]
    + [f"round(avg(recall_{k}), 6) AS recall_{k}" for k in evaluation.DEPTHS]
    + [f"round(avg(CAST(hit_{k} AS INT)), 6) AS hit_{k}" for k in evaluation.DEPTHS]
    + ["round(avg(rr), 6) AS mrr", "round(avg(ndcg), 6) AS ndcg"]
)


@register(
    "metrics_grouping_sets",
    f"WITH {_EVAL_SQL} SELECT business_type, difficulty, {_BLOCK_SQL} FROM res GROUP BY GROUPING SETS ((), (business_type), (difficulty))",
)
def metrics_grouping_sets(spark, sf):
    return evaluation.metric_block(_results(spark, sf), ["business_type", "difficulty"])


flagship = metrics_grouping_sets


@register(
    "first_relevant_rank",
    f"WITH {_EVAL_SQL} SELECT item_id AS query, min(rank) AS first_rank FROM gi LEFT JOIN r ON r.query = gi.item_id AND r.doc = gi.doc_id GROUP BY item_id",
)
def first_relevant_rank(spark, sf):
    gold = gold_pairs(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    top = _top(spark, sf, 10)
    return gold.join(top, ["query", "doc"], "left").groupBy("query").agg(F.min("rank").cast("long").alias("first_rank"))


@register(
    "corpus_correspondence",
    f"""WITH {GOLD_SQL} SELECT count(*) AS n_passages, count_if(n > 0) AS n_found, round(count_if(n > 0) / count(*), 6) AS share
    FROM (SELECT b.item_id, count(g.doc_id) AS n FROM benchmark b LEFT JOIN gold g ON b.item_id = g.item_id GROUP BY b.item_id)""",
)
def corpus_correspondence(spark, sf):
    found = gold_pairs(spark, sf).select("item_id").distinct().withColumn("found", F.lit(1))
    joined = table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_passages"),
        F.count("found").alias("n_found"),
        F.round(F.count("found") / F.count(F.lit(1)), 6).alias("share"),
    )


@register(
    "config_comparison",
    f"""WITH {PATHS_SQL}, {GOLD_SQL}, m AS (SELECT 'full' AS config, g.item_id, count_if(r1.rank <= 10) / count(*) AS recall FROM gold g LEFT JOIN r1 ON r1.query = g.item_id AND r1.doc = g.doc_id GROUP BY g.item_id
      UNION ALL SELECT 'half', g.item_id, count_if(r2.rank <= 10) / count(*) FROM gold g LEFT JOIN r2 ON r2.query = g.item_id AND r2.doc = g.doc_id GROUP BY g.item_id)
    SELECT config, count(*) AS n_queries, round(avg(recall), 6) AS recall_10, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id)) AS sample_hash FROM m GROUP BY config""",
)
def config_comparison(spark, sf):
    """Runs are comparable only if their sample hashes are equal."""
    gold = gold_pairs(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    top = _paths(spark, sf, 10)

    def run(name, path):
        per = gold.join(top.where(F.col("path") == path), ["query", "doc"], "left").groupBy("query").agg(
            (F.count("rank") / F.count(F.lit(1))).alias("recall")
        )
        return per.select(F.lit(name).alias("config"), "query", "recall")

    both = run("full", "bm25_es").unionByName(run("half", "rewrite_variants"))
    ordered = F.transform(F.array_sort(F.collect_list("query")), lambda x: x.cast("string"))
    return both.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("recall"), 6).alias("recall_10"),
        F.sha2(F.array_join(ordered, ","), 256).alias("sample_hash"),
    )


@register(
    "rerank_delta",
    f"""WITH {PATHS_SQL}, {GOLD_SQL}, t AS (SELECT g.item_id, coalesce(bool_or(r1.rank = 1), false) AS a, coalesce(bool_or(r2.rank = 1), false) AS b
      FROM gold g LEFT JOIN r1 ON r1.query = g.item_id AND r1.doc = g.doc_id LEFT JOIN r2 ON r2.query = g.item_id AND r2.doc = g.doc_id GROUP BY g.item_id)
    SELECT count(*) AS n, round(avg(CAST(a AS INT)), 6) AS positive_at_1_a, round(avg(CAST(b AS INT)), 6) AS positive_at_1_b,
      round(avg(CAST(b AS INT)) - avg(CAST(a AS INT)), 6) AS delta FROM t""",
)
def rerank_delta(spark, sf):
    gold = gold_pairs(spark, sf).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    top = _paths(spark, sf, 1)
    a = top.where("path = 'bm25_es'").select("query", "doc", F.lit(1.0).alias("a"))
    b = top.where("path = 'rewrite_variants'").select("query", "doc", F.lit(1.0).alias("b"))
    per = gold.join(a, ["query", "doc"], "left").join(b, ["query", "doc"], "left").groupBy("query").agg(
        F.coalesce(F.max("a"), F.lit(0.0)).alias("a"), F.coalesce(F.max("b"), F.lit(0.0)).alias("b")
    )
    return per.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("a"), 6).alias("positive_at_1_a"),
        F.round(F.avg("b"), 6).alias("positive_at_1_b"),
        F.round(F.avg("b") - F.avg("a"), 6).alias("delta"),
    )
