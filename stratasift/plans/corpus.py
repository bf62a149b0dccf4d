"""Queries over corpus building, lifecycle, provenance and access."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import access, ids, text
from stratasift.operators import corpus

from .catalog import register
from .fixtures import CHUNKS_SQL, MASKED_SQL, STATE_SQL, chunks, source_state, table, with_masks


def _docs(spark, sf):
    return table(spark, sf, "documents")


@register("chunk_windows", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, chunk, sha256(chunk) AS content_hash FROM chunks")
def chunk_windows(spark, sf):
    return chunks(_docs(spark, sf)).select("doc_id", "chunk_index", "chunk", F.sha2("chunk", 256).alias("content_hash"))


@register(
    "chunk_counts_by_lang",
    f"""WITH {CHUNKS_SQL} SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs,
      CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM chunks GROUP BY lang""",
)
def chunk_counts_by_lang(spark, sf):
    # Lengths follow from the text's length, so the windows themselves are not made.
    n = F.length("text")
    count = text.window_count(n)
    return (
        _docs(spark, sf)
        .select("lang", count.alias("k"), (n + F.greatest(count - 1, F.lit(0)) * text.CHUNK_OVERLAP).alias("chars"))
        .where("k > 0")
        .groupBy("lang")
        .agg(F.sum("k").alias("n_chunks"), F.count(F.lit(1)).alias("n_docs"), F.sum("chars").cast("long").alias("n_chars"))
    )


@register(
    "doc_identity",
    """SELECT doc_id, sha256('documents:' || source || '/' || doc_id) AS identity,
      sha256(doc_id || ':' || coalesce(CASE WHEN doc_id % 3 = 0 THEN 'e1' WHEN doc_id % 3 = 1 THEN 'e2' END, '')) AS index_id
    FROM documents""",
)
def doc_identity(spark, sf):
    d = with_masks(_docs(spark, sf))
    return d.select(
        "doc_id",
        ids.sha256(F.concat(F.lit("documents:"), "source", F.lit("/"), F.col("doc_id").cast("string"))).alias("identity"),
        ids.index_id(F.col("doc_id").cast("string"), F.col("epoch")).alias("index_id"),
    )


@register(
    "chunk_uuid5",
    f"""WITH {CHUNKS_SQL}, named AS (SELECT c.doc_id, chunk_index,
        sha1(unhex('{ids.CHUNK_NAMESPACE.hex}') || encode(c.doc_id || ':' || sha256(d.text) || ':' || chunk_index || ':' || sha256(chunk))) AS h
      FROM chunks c JOIN documents d ON c.doc_id = d.doc_id)
    SELECT doc_id, chunk_index, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
      substr('89ab', CAST(('0x' || h[17:17])::INT % 4 + 1 AS BIGINT), 1) || h[18:20] || '-' || h[21:32] AS chunk_id FROM named""",
)
def chunk_uuid5(spark, sf):
    docs = _docs(spark, sf).withColumn("doc_hash", F.sha2("text", 256))
    return chunks(docs).select(
        "doc_id",
        "chunk_index",
        ids.chunk_id(F.col("doc_id"), F.col("doc_hash"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"),
    )


@register(
    "corpus_fingerprint",
    f"""WITH h AS (SELECT sha256(doc_id || chr(31) || text) AS h FROM documents), {corpus.ordered_digest_sql('f', 'h')}
    SELECT d AS digest, n AS n_rows FROM f""",
)
def corpus_fingerprint(spark, sf):
    return corpus.ordered_digest(
        _docs(spark, sf), F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.col("text"))
    )


@register(
    "index_identity_fingerprint",
    f"""WITH {CHUNKS_SQL}, h AS (SELECT sha256(doc_id || chr(31) || chunk_index) AS h FROM chunks), {corpus.ordered_digest_sql('f', 'h')}
    SELECT d AS digest, n AS n_rows FROM f""",
)
def index_identity_fingerprint(spark, sf):
    n = text.window_count(F.length("text"))
    rows = _docs(spark, sf).where(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return corpus.ordered_digest(rows, F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.col("i").cast("string")))


@register(
    "text_normalize",
    r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS passage_hash,
      sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS question_hash FROM documents""",
)
def text_normalize(spark, sf):
    return _docs(spark, sf).select(
        "doc_id",
        F.sha2(text.normalize_passage(F.col("text")), 256).alias("passage_hash"),
        F.sha2(text.normalize_question(F.col("text")), 256).alias("question_hash"),
    )


@register(
    "exact_dup_groups",
    """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def exact_dup_groups(spark, sf):
    return (
        _docs(spark, sf)
        .groupBy(F.sha2("text", 256).alias("content_hash"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("copies > 1")
    )


@register(
    "html_visible_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS h FROM a),
    c AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t FROM b)
    SELECT page_id, sha256(t) AS text_hash, length(t) AS n_chars FROM c""",
)
def html_visible_text(spark, sf):
    t = text.visible_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", t.alias("t")).select(
        "page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("long").alias("n_chars")
    )


@register(
    "url_host_stats",
    r"""SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, count(*) AS n_pages,
      count(DISTINCT url) AS n_urls, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages GROUP BY 1""",
)
def url_host_stats(spark, sf):
    return (
        table(spark, sf, "pages")
        .groupBy(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1)).alias("host"))
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.countDistinct("url").alias("n_urls"),
            F.sum(F.length("html")).cast("long").alias("n_chars"),
        )
    )


@register(
    "article_segments",
    """WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS i, string_split(text, chr(10))[i] AS line
      FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
    s AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM l)
    SELECT doc_id, CAST(seg AS BIGINT) AS segment, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS body_hash
    FROM s GROUP BY doc_id, seg""",
)
def article_segments(spark, sf):
    """A short line opens a new segment."""
    lines = F.split("text", "\n")
    rows = _docs(spark, sf).select("doc_id", F.posexplode(lines).alias("i", "line"))
    seg = F.sum(F.when(F.length("line") < 40, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    return (
        rows.withColumn("segment", seg.cast("long"))
        .groupBy("doc_id", "segment")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sha2(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n"), 256
            ).alias("body_hash"),
        )
    )


_DIFF_SQL = (
    f"WITH {STATE_SQL}, "
    """diff AS (SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'NEW' WHEN c.doc_id IS NULL THEN 'DELETED'
      WHEN c.hash = s.hash AND c.role_mask IS NOT DISTINCT FROM s.role_mask AND c.dept_mask IS NOT DISTINCT FROM s.dept_mask
      THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change
    FROM current_state c FULL JOIN (SELECT * FROM stored_state WHERE status = 'active') s ON c.doc_id = s.doc_id)"""
)


def _diff(spark, sf):
    current, stored = source_state(_docs(spark, sf))
    return corpus.snapshot_diff(current, stored, "doc_id", ["hash", "role_mask", "dept_mask"])


@register("snapshot_diff", f"{_DIFF_SQL} SELECT doc_id, change FROM diff")
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@register("deleted_sources", f"{_DIFF_SQL} SELECT doc_id FROM diff WHERE change = 'DELETED'")
def deleted_sources(spark, sf):
    return _diff(spark, sf).where("change = 'DELETED'").select("doc_id")


@register(
    "carry_forward",
    f"""{_DIFF_SQL} SELECT m.doc_id, 'e9' AS epoch, m.status, sha256(m.text) AS content_hash
    FROM masked m WHERE doc_id IN (SELECT doc_id FROM diff WHERE change = 'UNCHANGED')""",
)
def carry_forward(spark, sf):
    old = with_masks(_docs(spark, sf)).select("doc_id", "epoch", "status", F.sha2("text", 256).alias("content_hash"))
    return corpus.carry_forward(old, _diff(spark, sf).where("change = 'UNCHANGED'"), "doc_id", "epoch", "e9")


@register(
    "state_upsert",
    f"""WITH {STATE_SQL} SELECT doc_id, hash, role_mask, dept_mask, 'active' AS status FROM current_state UNION ALL
    SELECT doc_id, hash, role_mask, dept_mask, status FROM stored_state WHERE doc_id NOT IN (SELECT doc_id FROM current_state)""",
)
def state_upsert(spark, sf):
    current, stored = source_state(_docs(spark, sf))
    return corpus.upsert(stored, current.withColumn("status", F.lit("active")), ["doc_id"])


@register(
    "expected_vs_present",
    f"""WITH {STATE_SQL} SELECT doc_id, 'missing' AS problem FROM current_state WHERE doc_id NOT IN (SELECT doc_id FROM stored_state)
    UNION ALL SELECT doc_id, 'unexpected' FROM stored_state WHERE doc_id NOT IN (SELECT doc_id FROM current_state)""",
)
def expected_vs_present(spark, sf):
    current, stored = source_state(_docs(spark, sf))
    return corpus.missing_and_unexpected(current, stored, "doc_id")


@register(
    "snapshot_validation_errors",
    f"""WITH {MASKED_SQL} SELECT 'mask_missing' AS check_name, CAST(doc_id AS VARCHAR) AS entity FROM masked WHERE role_mask IS NULL
    UNION ALL SELECT 'epoch_missing', CAST(doc_id AS VARCHAR) FROM masked WHERE epoch IS NULL AND status = 'active'
    UNION ALL SELECT 'duplicate_content', sha256(text) FROM masked WHERE status = 'active' GROUP BY text HAVING count(*) > 1""",
)
def snapshot_validation_errors(spark, sf):
    d = with_masks(_docs(spark, sf))

    def rule(name, rows):
        return rows.select(F.lit(name).alias("check_name"), F.col("entity").cast("string").alias("entity"))

    dup = (
        d.where("status = 'active'").groupBy(F.sha2("text", 256).alias("entity")).count().where("count > 1").drop("count")
    )
    slim = d.select(F.col("doc_id").alias("entity"), "role_mask", "epoch", "status")
    return (
        rule("mask_missing", slim.where("role_mask is null"))
        .unionByName(rule("epoch_missing", slim.where("epoch is null and status = 'active'")))
        .unionByName(rule("duplicate_content", dup))
    )


@register("epoch_counts", f"WITH {MASKED_SQL} SELECT epoch, status, count(*) AS n FROM masked GROUP BY epoch, status")
def epoch_counts(spark, sf):
    return with_masks(_docs(spark, sf)).groupBy("epoch", "status").agg(F.count(F.lit(1)).alias("n"))


@register(
    "epoch_binding",
    f"""WITH {MASKED_SQL} SELECT e AS epoch, count(m.doc_id) AS n, count(m.doc_id) > 0 AS bound
    FROM (VALUES ('e1'), ('e2'), ('e3')) t(e) LEFT JOIN masked m ON m.epoch = e GROUP BY e""",
)
def epoch_binding(spark, sf):
    wanted = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "epoch string")
    counts = with_masks(_docs(spark, sf)).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))
    joined = wanted.join(counts, "epoch", "left").select("epoch", F.coalesce("n", F.lit(0)).alias("n"))
    return joined.withColumn("bound", F.col("n") > 0)


_TRUST_SQL = f"""dh AS (SELECT source AS source_id, sha256(text) AS h FROM documents), {corpus.ordered_digest_sql('sd', 'dh', 'source_id')},
src AS (SELECT source_id, d AS content_hash, CASE WHEN CAST(substr(source_id, 4) AS INT) < 10 THEN 'UNTRUSTED_EXTERNAL' ELSE 'MANAGED_INTERNAL' END AS trust FROM sd),
ledger AS (SELECT source_id, CASE WHEN k % 4 = 1 THEN sha256(content_hash) ELSE content_hash END AS content_hash,
    CASE WHEN k % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decided FROM (SELECT *, CAST(substr(source_id, 4) AS INT) AS k FROM src) WHERE k < 10 AND k % 3 <> 2),
resolved AS (SELECT s.source_id, s.trust, coalesce(l.decided, CASE WHEN s.trust = 'MANAGED_INTERNAL' THEN 'NOT_REQUIRED' ELSE 'PENDING_REVIEW' END) AS approval
  FROM src s LEFT JOIN ledger l ON s.source_id = l.source_id AND s.content_hash = l.content_hash),
classed AS (SELECT *, CASE WHEN trust = 'MANAGED_INTERNAL' AND approval = 'NOT_REQUIRED' THEN 'MANAGED_INTERNAL'
  WHEN trust = 'UNTRUSTED_EXTERNAL' AND approval = 'APPROVED' THEN 'APPROVED_EXTERNAL'
  WHEN trust = 'UNTRUSTED_EXTERNAL' AND approval IN ('PENDING_REVIEW', 'REJECTED') THEN 'UNTRUSTED' END AS trust_class FROM resolved)"""


def _sources(spark, sf):
    docs = _docs(spark, sf).select(F.col("source").alias("source_id"), "text")
    src = corpus.ordered_digest(docs, F.col("text"), ["source_id"]).select("source_id", F.col("digest").alias("content_hash"))
    k = F.substring("source_id", 4, 10).cast("int")
    return src.withColumn("trust", F.when(k < 10, "UNTRUSTED_EXTERNAL").otherwise("MANAGED_INTERNAL"))


def _ledger(src):
    k = F.substring("source_id", 4, 10).cast("int")
    return src.where((k < 10) & (k % 3 != 2)).select(
        "source_id",
        F.when(k % 4 == 1, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(k % 2 == 0, "APPROVED").otherwise("REJECTED").alias("decided"),
    )


@register("trust_class_resolution", f"WITH {_TRUST_SQL} SELECT source_id, trust, approval, trust_class FROM classed")
def trust_class_resolution(spark, sf):
    src = _sources(spark, sf)
    return corpus.resolve_trust(src, _ledger(src)).select("source_id", "trust", "approval", "trust_class")


@register(
    "trust_manifest",
    f"""WITH {_TRUST_SQL} SELECT trust_class, count(*) AS n_sources, string_agg(source_id, ',' ORDER BY source_id) AS sources FROM classed GROUP BY trust_class""",
)
def trust_manifest(spark, sf):
    return (
        trust_class_resolution(spark, sf)
        .groupBy("trust_class")
        .agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("sources"))
    )


@register(
    "source_approval",
    f"""WITH {_TRUST_SQL} SELECT s.source_id, CASE WHEN l.source_id IS NULL AND s.trust = 'MANAGED_INTERNAL' THEN 'not_required'
      WHEN l.source_id IS NULL THEN 'no_decision' WHEN l.content_hash <> s.content_hash THEN 'stale_decision'
      WHEN l.decided = 'REJECTED' THEN 'rejected' ELSE 'approved' END AS verdict
    FROM src s LEFT JOIN ledger l USING (source_id)""",
)
def source_approval(spark, sf):
    src = _sources(spark, sf)
    ledger = _ledger(src).withColumnRenamed("content_hash", "decided_hash")
    verdict = (
        F.when(F.col("decided").isNull() & (F.col("trust") == "MANAGED_INTERNAL"), "not_required")
        .when(F.col("decided").isNull(), "no_decision")
        .when(F.col("decided_hash") != F.col("content_hash"), "stale_decision")
        .when(F.col("decided") == "REJECTED", "rejected")
        .otherwise("approved")
    )
    return src.join(ledger, "source_id", "left").select("source_id", verdict.alias("verdict"))


@register(
    "permission_glob",
    """SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path,
      CASE WHEN source LIKE 'src1%' THEN 1 WHEN source || '/' || lang || '/' || doc_id || '.txt' LIKE '%/fr/%' THEN 2 ELSE 4 END AS role_mask FROM documents""",
)
def permission_glob(spark, sf):
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    d = _docs(spark, sf).select("doc_id", path.alias("path"))
    return d.withColumn("role_mask", access.first_glob(F.col("path"), [("src1*", 1), ("*/fr/*", 2)], 4))


_USERS = [("u_public", 0, 0), ("u_r1", 1, 1), ("u_r2", 2, 6), ("u_all", 15, 15), ("u_admin", 0xFFFFFFFF, 0)]
_USERS_SQL = "users(user_id, ur, ud) AS (VALUES " + ", ".join(f"('{u}', {r}::BIGINT, {d}::BIGINT)" for u, r, d in _USERS) + ")"
_VISIBLE_SQL = """role_mask IS NOT NULL AND dept_mask IS NOT NULL AND (ur = 4294967295 OR
  ((role_mask = 0 OR role_mask & ur <> 0) AND (dept_mask = 0 OR dept_mask & ud <> 0)))"""


@register("rbac_visible_docs", f"WITH {MASKED_SQL}, {_USERS_SQL} SELECT doc_id FROM masked, users WHERE user_id = 'u_r2' AND {_VISIBLE_SQL}")
def rbac_visible_docs(spark, sf):
    ok = access.is_authorized(F.col("role_mask"), F.lit(2).cast("long"), F.col("dept_mask"), F.lit(6).cast("long"))
    return with_masks(_docs(spark, sf)).where(ok).select("doc_id")


@register(
    "rbac_by_identity_matrix",
    f"WITH {MASKED_SQL}, {_USERS_SQL} SELECT user_id, count(*) AS n_docs, count_if({_VISIBLE_SQL}) AS n_visible FROM masked, users GROUP BY user_id",
)
def rbac_by_identity_matrix(spark, sf):
    """One scan whatever the number of users: each is a column of the aggregate, turned into a row at the end."""
    d = with_masks(_docs(spark, sf))

    def visible(r, u):
        return access.is_authorized(F.col("role_mask"), F.lit(r).cast("long"), F.col("dept_mask"), F.lit(u).cast("long"))

    one = d.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(visible(r, u)).alias(name) for name, r, u in _USERS])
    return one.unpivot(["n_docs"], [name for name, _, _ in _USERS], "user_id", "n_visible").select(
        "user_id", "n_docs", "n_visible"
    )


@register("epoch_filter", f"WITH {MASKED_SQL} SELECT doc_id FROM masked WHERE status = 'active' AND epoch = 'e2'")
def epoch_filter(spark, sf):
    return with_masks(_docs(spark, sf)).where((F.col("status") == "active") & access.in_epoch(F.col("epoch"), "e2")).select("doc_id")


@register(
    "legacy_default_epoch",
    f"WITH {MASKED_SQL} SELECT doc_id FROM masked WHERE status = 'active' AND (epoch = 'default' OR epoch IS NULL)",
)
def legacy_default_epoch(spark, sf):
    return with_masks(_docs(spark, sf)).where((F.col("status") == "active") & access.in_epoch(F.col("epoch"), "default")).select("doc_id")


@register(
    "mask_encode",
    """SELECT source, CAST(coalesce(bit_or(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 4 END), 0) AS BIGINT) AS mask FROM documents GROUP BY source""",
)
def mask_encode(spark, sf):
    bits = spark.createDataFrame([("en", 1), ("fr", 2), ("de", 4)], "lang string, bit long")
    return (
        _docs(spark, sf).join(F.broadcast(bits), "lang", "left").groupBy("source").agg(access.mask_of(F.col("bit")).alias("mask"))
    )


@register(
    "identifier_checks",
    r"""SELECT page_id, regexp_matches(url, '^[A-Za-z0-9_-]+$') AS url_is_id, regexp_matches(CAST(page_id AS VARCHAR), '^[A-Za-z0-9_-]+$') AS page_is_id,
      NOT starts_with(p, '/') AND NOT regexp_matches(p, '(^|/)\.\.(/|$)') AS inside FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN '../' ELSE '' END || page_id || '.html' AS p FROM pages)""",
)
def identifier_checks(spark, sf):
    path = F.concat(F.when(F.col("page_id") % 5 == 0, "../").otherwise(""), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf, "pages").select(
        "page_id",
        access.valid_identifier(F.col("url")).alias("url_is_id"),
        access.valid_identifier(F.col("page_id").cast("string")).alias("page_is_id"),
        access.inside_root(path).alias("inside"),
    )
