"""Queries that take structure out of texts: scans for labelled content, articles, rewrites and JSON differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import text
from stratasift.operators import content_scan as scan
from stratasift.operators import extraction

from .catalog import register
from .fixtures import table

# --- scans -------------------------------------------------------------------

#: Lines that are added to every seventh document, in turn.
_PLANTED = (
    "本项目面向求职者,附简历与面试指南",
    "A former employer ran this; the job application is attached.",
    "regulation of a former employer, rerank candidates",
    "Weights are derived from production traffic and won the 年度创新奖.",
    "An independent reproduction of the company system with 任职期间 notes",
    "resume the ingestion run after the job application",
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PLANTED_SQL = "CASE doc_id // 7 % 6 " + " ".join(f"WHEN {i} THEN {_quoted(x)}" for i, x in enumerate(_PLANTED)) + " END"
_PATTERNS_SQL = "p(i, family, label, shape) AS (VALUES " + ", ".join(f"({i}, {_quoted(p.family)}, {_quoted(p.label)}, {_quoted(p.shape)})" for i, p in enumerate(scan.CONTENT_PATTERNS)) + ")"


@register(
    "content_scan",
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat_ws(chr(10), text, {_PLANTED_SQL}) ELSE coalesce(text, '') END AS x FROM documents),
    l AS (SELECT doc_id, CAST(i AS BIGINT) AS line, string_split(x, chr(10))[i] AS x FROM t, unnest(range(1, len(string_split(x, chr(10))) + 1)) u(i)),
    {_PATTERNS_SQL}, m AS (SELECT doc_id, line, family, label, row_number() OVER (PARTITION BY doc_id, line, family ORDER BY i) AS k FROM l, p
      WHERE length(x) <= 2000 AND regexp_matches(x, shape) AND NOT regexp_matches(x, {_quoted(scan.TECHNICAL_CONTEXT)}))
    SELECT doc_id, line, family, label FROM m WHERE k = 1""",
)
def content_scan(spark, sf):
    """Forbidden content by family and line; lines about engineering are let through."""
    turn = F.floor(F.col("doc_id") / 7) % len(_PLANTED)
    extra = F.lit(None)
    for i, line in enumerate(_PLANTED):
        extra = F.when(turn == i, line).otherwise(extra)
    body = F.when(F.col("doc_id") % 7 == 0, F.concat_ws("\n", "text", extra)).otherwise(F.col("text"))
    return scan.scan_lines(table(spark, sf, "documents"), "doc_id", body).withColumnRenamed("key", "doc_id")


_NAMES = ("RESUME_2.pdf", "interview-notes.md", "cv.html", "cover letter.txt", "index.html", "job_description.md", "recruit.csv", "performance-review")
_NAMES_SQL = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {_quoted(x)}" for i, x in enumerate(_NAMES)) + " END"


@register(
    "path_scan",
    f"""WITH n AS (SELECT page_id, {_NAMES_SQL} AS name FROM pages), s AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM n)
    SELECT page_id, name, CASE """
    + " ".join(f"WHEN regexp_matches(stem, {_quoted(p.shape)}) OR regexp_matches(name, {_quoted(p.shape)}) THEN {_quoted(p.label)}" for p in scan.PATH_PATTERNS)
    + " END AS label FROM s WHERE label IS NOT NULL",
)
def path_scan(spark, sf):
    """File names of forbidden material below the pages' paths."""
    name = F.lit(None)
    for i, x in enumerate(_NAMES):
        name = F.when(F.col("page_id") % len(_NAMES) == i, x).otherwise(name)
    path = F.concat(F.regexp_extract("url", r"^[a-z]+://[^?#]*", 0), F.lit("/"), name)
    return scan.scan_paths(table(spark, sf, "pages"), "page_id", path).withColumnRenamed("key", "page_id")


# --- articles ----------------------------------------------------------------

#: Headings and paragraphs keep a mark when tags go.
PAGE_GRAMMAR = extraction.LineGrammar(article=r"^§ ?(\S*)", chapter=r"^(# .*)", body_start=r"^# ", tail=r"^&copy;")


@register(
    "page_articles",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '<p>', chr(10) || '§ ', 'g') AS h FROM pages),
    s AS (SELECT page_id, regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g') AS h FROM a),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS h FROM s),
    c AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM b),
    l AS (SELECT page_id, i, ls[i] AS x FROM c, unnest(range(1, len(ls) + 1)) u(i)),
    f AS (SELECT page_id, min(i) FILTER (starts_with(x, '# ')) AS b FROM l GROUP BY page_id),
    g AS (SELECT l.page_id, f.b, min(i) FILTER (starts_with(x, '&copy;')) AS e FROM l JOIN f USING (page_id) WHERE i >= f.b GROUP BY ALL),
    w AS (SELECT l.page_id, i, x, starts_with(x, '# ') AS ch, starts_with(x, '§') AS ar FROM l JOIN g USING (page_id) WHERE i >= b AND (e IS NULL OR i < e)),
    n AS (SELECT *, sum(CAST(ar AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS article, last_value(CASE WHEN ch THEN x END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS chapter FROM w)
    SELECT page_id, CAST(article AS INT) AS article, regexp_extract(min(x) FILTER (ar), '^§ ?(\S*)', 1) AS name, min(chapter) FILTER (ar) AS chapter,
      CAST(count(*) FILTER (NOT ch) AS INT) AS n_lines, sha256(string_agg(x, chr(10) ORDER BY i) FILTER (NOT ch)) AS body_hash
    FROM n WHERE article > 0 GROUP BY page_id, article""",
)
def page_articles(spark, sf):
    """The paragraphs of each page's article, below its heading and without what surrounds it."""
    marked = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<p>", "\n§ ")
    found = extraction.articles(table(spark, sf, "pages"), "page_id", text.visible_html(marked), PAGE_GRAMMAR)
    return found.select(F.col("key").alias("page_id"), "article", "name", "chapter", "n_lines", F.sha2("body", 256).alias("body_hash"))


# --- JSON --------------------------------------------------------------------


@register(
    "rewrite_repair",
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 4 THEN 'the question' ELSE 'q } ' || event_id END AS rewritten_query,
      CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'general' WHEN 3 THEN 'ingredient' ELSE 'regulation' END AS business_type,
      CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'general' WHEN 0 THEN 'compliance' WHEN 1 THEN 'compliance' WHEN 2 THEN 'limits' ELSE 'ingredient' END AS intent,
      CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 0.5 ELSE (event_id % 10) / 10 END AS confidence FROM events""",
)
def rewrite_repair(spark, sf):
    """Answers with prose, other braces and contradictions around the object that is wanted."""
    e = F.col("event_id")
    intent = F.when(e % 6 == 0, "ingredient").when(e % 6 == 1, "formulation").when(e % 6 == 2, "limits").otherwise("ingredient")
    wanted = F.concat(
        F.lit('Of course {not json} 5" pipe: {"rewritten_query": "q } '), e.cast("string"), F.lit('", "business_type": "'),
        F.when(e % 6 == 3, "ingredient").otherwise("regulation"), F.lit('", "intent": "'), intent, F.lit('", "more": {"a": [1, {}]}, "confidence": '),
        (e % 10 / 10).cast("string"), F.lit('} and then {"rewritten_query": "second"}'),
    )
    answer = F.when(e % 6 == 5, "no object { here").when(e % 6 == 4, 'empty: {} and {"intent": "late"}').otherwise(wanted)
    parsed = extraction.parsed_rewrite(answer, F.lit("the question"))
    rows = table(spark, sf, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", "p.rewritten_query", "p.business_type", "p.intent", "p.confidence")


@register(
    "json_structure_diff",
    """WITH k AS (SELECT event_id, event_id % 4 AS m, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, 'a.list' AS path, 'length' AS problem FROM k WHERE m = 1
    UNION ALL SELECT event_id, 't', 'left only' FROM k WHERE m = 2 UNION ALL SELECT event_id, 'u', 'right only' FROM k WHERE m = 2
    UNION ALL SELECT event_id, 't', 'kind' FROM k WHERE m = 3 UNION ALL SELECT event_id, 'a.list[1].x', 'value' FROM k WHERE m = 3
    UNION ALL SELECT event_id, 'a.props.k', 'value' FROM k WHERE k % 2 <> 0""",
)
def json_structure_diff(spark, sf):
    """Paths at which two versions of the events' properties differ."""
    e = F.col("event_id") % 4
    k = F.get_json_object("props", "$.k").cast("long")
    left = F.concat(F.lit('{"a": {"props": '), "props", F.lit(', "list": [1, {"x": 1}]}, "t": {"deep": 1}}'))
    items = F.when(e == 1, "[1]").when(e == 3, '[1, {"x": 2}]').otherwise('[1, {"x": 1}]')
    rest = F.when(e == 2, '"u": [1]').when(e == 3, '"t": "one"').otherwise('"t": {"deep": 1}')
    even = F.concat(F.lit('{"k": '), (k - F.abs(k % 2)).cast("string"), F.lit("}"))
    right = F.concat(F.lit('{"a": {"list": '), items, F.lit(', "props": '), even, F.lit("}, "), rest, F.lit("}"))
    return extraction.json_differences(table(spark, sf, "events"), "event_id", left, right).withColumnRenamed("key", "event_id")
