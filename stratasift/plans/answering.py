"""The composed question plan: recall, fusion, fallback, permissions, reranking, both gates and the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import access, rules, text
from stratasift.operators import answering

from .catalog import register
from .fixtures import MASKED_SQL, table, with_masks
from .retrieval_eval import PATHS_SQL, _top_paths

_VISIBLE_SQL = "role_mask IS NOT NULL AND dept_mask IS NOT NULL AND (role_mask = 0 OR role_mask & 2 <> 0) AND (dept_mask = 0 OR dept_mask & 6 <> 0)"


def _grams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(1, length(substr({c}, 1, 500)) - 1)), lambda i: substr(substr({c}, 1, 500), CAST(i AS BIGINT), 3)))"


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _characters_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ''), lambda x: x <> ''))"


def _against_sql(p: str, h: str) -> str:
    return f"CASE WHEN len({p}) = 0 OR len({h}) = 0 THEN 0.1 ELSE greatest(0, least(0.3 * len(list_filter({h}, lambda x: NOT list_contains({p}, x))) / len({p}), 0.6)) END"


_SQL = f"""WITH {PATHS_SQL}, {MASKED_SQL},
qs AS (SELECT item_id AS query, text, item_id % 2 = 0 AS reg, item_id % 3 <> 0 AS complex, item_id % 5 = 0 AS careful FROM benchmark),
vis AS (SELECT doc_id AS doc FROM masked WHERE {_VISIBLE_SQL}),
rec AS (SELECT path, p.query, doc, rank, reg FROM paths p JOIN qs USING (query) WHERE (complex OR path = 'bm25_es') AND (path = 'bm25_es' OR rank <= 10)),
fu AS (SELECT query, doc, round(sum((CASE WHEN path = 'bm25_es' AND reg THEN 1.5 ELSE 1.0 END) / (60 + rank)), 9) AS score, count(*) AS n_paths FROM rec GROUP BY query, doc),
fr AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, n_paths DESC, doc) AS rank FROM fu JOIN vis USING (doc)),
fn AS (SELECT query, count(*) AS n, max(rank) AS last FROM fr GROUP BY query),
fb AS (SELECT h.query, h.doc, coalesce(last, 0) + row_number() OVER (PARTITION BY h.query ORDER BY h.rank, h.doc) AS rank FROM r2 h JOIN vis ON vis.doc = h.doc LEFT JOIN fn ON fn.query = h.query
  WHERE coalesce(n, 0) < 50 AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.query = h.query AND fr.doc = h.doc)),
al AS (SELECT query, doc, rank, 'fused' AS origin FROM fr UNION ALL SELECT query, doc, rank, 'fallback' FROM fb),
cn AS (SELECT query, count(*) AS n_recalled, count_if(origin = 'fallback') AS n_fallback FROM al GROUP BY query),
cg AS (SELECT al.query, al.doc, d.text AS body, {_grams_sql('qs.text')} AS gq, {_grams_sql('d.text')} AS gd FROM al JOIN qs USING (query) JOIN documents d ON d.doc_id = al.doc WHERE rank <= 30),
sc AS (SELECT query, doc, body, round(1 / (1 + exp(-(8 * ({_jaccard_sql('gq', 'gd')}) - 1))), 6) AS score FROM cg),
tp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 3),
ch AS (SELECT query, rank, {_characters_sql('substr(body, 1, 512)')} AS c FROM tp),
co AS (SELECT a.query, 1 - avg(CASE WHEN {_against_sql('a.c', 'b.c')} > 0.5 THEN 1.0 ELSE 0.0 END) AS consistency FROM ch a JOIN ch b ON a.query = b.query AND a.rank < b.rank GROUP BY a.query),
ag AS (SELECT a.query, round(len(list_intersect(a.docs, b.docs)) / len(list_distinct(list_concat(a.docs, b.docs))), 6) AS agreement
  FROM (SELECT query, list(DISTINCT doc) AS docs FROM rec WHERE rank <= 10 AND path = 'bm25_es' GROUP BY query) a JOIN (SELECT query, list(DISTINCT doc) AS docs FROM rec WHERE rank <= 10 AND path <> 'bm25_es' GROUP BY query) b ON a.query = b.query),
ga AS (SELECT query, max(CASE WHEN rank = 1 THEN score END) AS top1, avg(score) AS mean3, max(CASE WHEN rank = 1 THEN body END) AS body, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY rank) AS docs FROM tp GROUP BY query),
ev AS (SELECT qs.*, coalesce(n_recalled, 0) AS n_recalled, coalesce(n_fallback, 0) AS n_fallback, body, docs, coalesce(agreement, 0) AS agreement,
  coalesce(round(0.4 * top1 + 0.3 * mean3 + 0.2 * coalesce(agreement, 0) + 0.1 * coalesce(consistency, 1), 6), 0) AS evidence
  FROM qs LEFT JOIN cn USING (query) LEFT JOIN ga USING (query) LEFT JOIN ag USING (query) LEFT JOIN co USING (query)),
de AS (SELECT *, CASE WHEN evidence >= CASE WHEN careful OR agreement < 0.3 THEN 0.80 ELSE 0.75 END THEN 'pass' WHEN evidence >= CASE WHEN careful OR agreement < 0.3 THEN 0.65 ELSE 0.55 END THEN 'enhanced_generate' ELSE 'reject' END AS decision FROM ev),
an AS (SELECT *, CASE WHEN decision <> 'reject' AND body IS NOT NULL THEN substr(body, 1, 200) END AS answer FROM de),
gr AS (SELECT *, {_grams_sql('answer')} AS ga, {_grams_sql('body')} AS gb, {_characters_sql('body')} AS cb, {_characters_sql('answer')} AS ca FROM an),
sm AS (SELECT *, CASE WHEN answer IS NOT NULL THEN round({_jaccard_sql('ga', 'gb')}, 6) END AS sim, CASE WHEN answer IS NOT NULL THEN {_against_sql('cb', 'ca')} END AS against FROM gr),
ve AS (SELECT *, CASE WHEN answer IS NULL THEN NULL WHEN sim > 0.6 THEN true WHEN sim < 0.15 THEN NOT reg ELSE against <= CASE WHEN reg THEN 0.5 ELSE 0.6 END END AS passed,
  CASE WHEN answer IS NULL THEN NULL WHEN sim > 0.6 THEN false WHEN sim < 0.15 THEN true ELSE against > 0.5 END AS warned FROM sm)
SELECT query, n_recalled, n_fallback, evidence, decision, answer, passed, warned, CASE WHEN passed THEN docs END AS locked,
  CASE WHEN NOT passed THEN 'rejected_by_answer_gate' WHEN decision = 'reject' THEN 'rejected_by_evidence_gate' WHEN answer IS NOT NULL THEN 'answered' ELSE 'rejected_by_evidence_gate' END AS outcome FROM ve"""


@register("answer_plan", _SQL)
def answer_plan(spark, sf):
    """All questions from recall to outcome; trigram overlap stands for the reranker and a document's beginning for the answer."""
    i = F.col("item_id")
    questions = table(spark, sf, "benchmark").select(
        i.alias("query"), "text", (i % 2 == 0).alias("is_regulation"), (i % 3 != 0).alias("is_complex"), (i % 5 == 0).alias("conservative")
    )
    top = _top_paths(spark, sf, 50).select("path", "query", "doc", "rank")
    recalled = top.where("path = 'bm25_es' or rank <= 10")
    fallback = top.where("path = 'rewrite_variants'").select("query", "doc", "rank")
    docs = table(spark, sf, "documents")
    ok = access.is_authorized(F.col("role_mask"), F.lit(2).cast("long"), F.col("dept_mask"), F.lit(6).cast("long"))
    visible = with_masks(docs.select("doc_id")).where(ok).select(F.col("doc_id").alias("doc"))
    bodies = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))

    def overlap(question, body):
        return rules.platt(text.ngram_jaccard(F.substring(question, 1, 500), F.substring(body, 1, 500)), 8.0, -1.0)

    return answering.answer_questions(questions, recalled, fallback, visible, bodies, overlap, lambda question, body: F.substring(body, 1, 200))
