"""Queries over evaluation datasets: identifiers, approval, attribution, legacy validation and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import rules, text
from stratasift.operators import contracts

from .catalog import register
from .fixtures import MASKED_SQL, table, with_masks
from .governance import _REASONS_SQL, _golden

_CHUNK_COUNT = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 50) / 450.0) AS BIGINT)) END"


@register(
    "identifier_existence",
    f"""WITH {MASKED_SQL}, ix AS (SELECT doc_id, coalesce(epoch, '') AS epoch, {_CHUNK_COUNT} AS n FROM masked),
    a AS (SELECT doc_id, CAST(doc_id % 5 AS INT) AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'e1' ELSE 'e2' END AS epoch FROM labels)
    SELECT a.doc_id, a.chunk_index, a.epoch FROM a WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.doc_id = a.doc_id AND ix.epoch = a.epoch AND a.chunk_index < ix.n)""",
)
def identifier_existence(spark, sf):
    """Annotations whose document, chunk and epoch are not in the index."""
    # Chunks are numbered without gaps, so their number says which there are.
    index = with_masks(table(spark, sf, "documents")).where("epoch is not null").select("doc_id", "epoch", text.window_count(F.length("text")).alias("n"))
    e = F.col("doc_id")
    annotations = table(spark, sf, "labels").select(
        "doc_id", (e % 5).cast("int").alias("chunk_index"), F.when(e % 2 == 0, "e1").otherwise("e2").alias("epoch")
    )
    return contracts.unresolved_chunks(annotations, index, ["doc_id", "epoch"])


@register(
    "gold_chunk_approval",
    """WITH g AS (SELECT DISTINCT 'd' || (doc_id + i) || '::c0' AS chunk_id FROM labels, range(0, 3) t(i)),
    ix AS (SELECT 'd' || doc_id || '::c0' AS chunk_id, CAST(substr(source, 4) AS INT) % 2 = 0 AS approved FROM documents WHERE doc_id % 7 <> 0)
    SELECT g.chunk_id, CASE WHEN ix.chunk_id IS NULL THEN 'not_indexed' WHEN approved THEN 'approved' ELSE 'unapproved_source' END AS verdict FROM g LEFT JOIN ix USING (chunk_id)""",
)
def gold_chunk_approval(spark, sf):
    """Whether what the golden rows point at comes from approved sources."""
    rows = table(spark, sf, "labels").select(
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("d"), (F.col("doc_id") + i).cast("string"), F.lit("::c0"))).alias("chunk_ids")
    )
    index = table(spark, sf, "documents").where("doc_id % 7 <> 0").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("::c0")).alias("chunk_id"),
        (F.substring("source", 4, 10).cast("int") % 2 == 0).alias("approved"),
    )
    return contracts.gold_approval(rows, "chunk_ids", index)


@register(
    "attributable_split",
    f"WITH {_REASONS_SQL} SELECT item_id, len(reasons) = 0 AS kept, coalesce(reasons[1], '') AS first_reason FROM rs",
)
def attributable_split(spark, sf):
    """Rows that may be scored, and the others with the first reason why not."""
    kept, excluded = contracts.attributable(_golden(spark, sf))
    a = kept.select("item_id", F.lit(True).alias("kept"), F.lit("").alias("first_reason"))
    return a.unionByName(excluded.select("item_id", F.lit(False).alias("kept"), F.element_at("reasons", 1).alias("first_reason")))


_LEGACY_SQL = """lg AS (SELECT doc_id AS n, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'q' || doc_id END AS question, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'a' END AS answer,
  CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 6 = 0 THEN ['x', ' '] ELSE ['x'] END AS contexts, 'gt' AS ground_truth,
  CASE WHEN doc_id % 9 = 0 THEN 'other' WHEN doc_id % 4 = 0 THEN NULL ELSE 'formula' END AS business_type, CASE WHEN doc_id % 8 = 0 THEN 'extreme' ELSE 'easy' END AS difficulty FROM labels)"""


@register(
    "legacy_golden_errors",
    f"""WITH {_LEGACY_SQL}, e AS (SELECT n, unnest(CASE WHEN answer IS NULL THEN ['missing_answer'] ELSE list_filter([
      CASE WHEN trim(question) = '' THEN 'blank_question' END, CASE WHEN len(contexts) = 0 THEN 'no_contexts' END, CASE WHEN len(contexts) > 1 THEN 'blank_context_1' END,
      CASE WHEN business_type = 'other' THEN 'invalid_business_type' END, CASE WHEN difficulty = 'extreme' THEN 'invalid_difficulty' END], lambda x: x IS NOT NULL) END) AS error FROM lg),
    t AS (SELECT count(*) AS c FROM lg)
    SELECT n, error FROM e UNION ALL SELECT NULL, 'too_few_entries' FROM t WHERE c < 300
    UNION ALL SELECT NULL, 'no_business_type_' || b FROM t, (VALUES ('regulation'), ('ingredient'), ('image'), ('general'), ('product')) v(b) WHERE c >= 300
    UNION ALL SELECT NULL, 'no_difficulty_' || b FROM t, (VALUES ('medium'), ('hard')) v(b) WHERE c >= 300""",
)
def legacy_golden_errors(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").select(
        d.alias("n"),
        F.when(d % 7 == 0, " ").otherwise(F.concat(F.lit("q"), d.cast("string"))).alias("question"),
        F.when(d % 10 != 0, "a").alias("answer"),
        F.when(d % 5 == 0, F.array().cast("array<string>")).when(d % 6 == 0, F.array(F.lit("x"), F.lit(" "))).otherwise(F.array(F.lit("x"))).alias("contexts"),
        F.lit("gt").alias("ground_truth"),
        F.when(d % 9 == 0, "other").when(d % 4 != 0, "formula").alias("business_type"),
        F.when(d % 8 == 0, "extreme").otherwise("easy").alias("difficulty"),
    )
    return contracts.legacy_errors(rows, "n")


@register(
    "dataset_provenance",
    """WITH p AS (SELECT doc_id, 'data/set' || doc_id % 40 || '.jsonl' AS path FROM labels),
    m AS (SELECT 'data/set' || i || '.jsonl' AS path, CASE WHEN i % 3 = 0 THEN 'SYNTHETIC' ELSE 'LICENSED' END AS class, CASE WHEN i % 4 = 0 THEN false WHEN i % 4 = 1 THEN true END AS claims FROM range(0, 20) t(i))
    SELECT doc_id, p.path, coalesce(class, 'UNCLASSIFIED') AS data_class, claims, coalesce(class = 'SYNTHETIC' AND claims = false, false) AS noticed FROM p LEFT JOIN m USING (path)""",
)
def dataset_provenance(spark, sf):
    """A path that no manifest declares is unclassified, with unknown claims."""

    def path(n):
        return F.concat(F.lit("data/set"), n.cast("string"), F.lit(".jsonl"))

    i = F.col("id")
    manifest = spark.range(20).select(
        path(i).alias("path"),
        F.when(i % 3 == 0, "SYNTHETIC").otherwise("LICENSED").alias("class"),
        F.when(i % 4 == 0, False).when(i % 4 == 1, True).alias("claims"),
    )
    rows = table(spark, sf, "labels").select("doc_id", path(F.col("doc_id") % 40).alias("path"))
    return contracts.data_class(rows, manifest)


_TERM, _NAMES = "甲醇", ["苯甲醇", "甲醇", "甲醇 x", "苯甲醇和 甲醇。", "苯甲醇, 甲醇钠", "water", "x甲醇x", "甲醇甲醇"]


@register(
    "embedded_terms",
    f"""WITH n AS (SELECT doc_id, [{', '.join(f"'{x}'" for x in _NAMES)}][CAST(doc_id % 8 + 1 AS BIGINT)] AS t FROM documents)
    SELECT doc_id, contains(t, '{_TERM}') AS found, contains(t, '{_TERM}') AND NOT regexp_matches(t, '(^|[^一-鿿]){_TERM}($|[^一-鿿])') AS embedded FROM n""",
)
def embedded_terms(spark, sf):
    """A term that occurs only inside longer names is no evidence for it."""
    names = F.array(*[F.lit(x) for x in _NAMES])
    rows = table(spark, sf, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")).alias("t"))
    return rows.select("doc_id", F.contains("t", F.lit(_TERM)).alias("found"), text.only_embedded(F.col("t"), _TERM).alias("embedded"))


@register(
    "question_category",
    """WITH q AS (SELECT item_id, (['image', 'product', 'regulation', 'ingredient', 'general', 'formula'])[CAST(item_id % 6 + 1 AS BIGINT)] AS b,
      CASE WHEN item_id % 4 = 0 THEN '请问' ELSE '' END || text AS question, item_id % 5 AS n FROM benchmark)
    SELECT item_id, CASE b WHEN 'image' THEN 'image_related' WHEN 'product' THEN 'product_knowledge' WHEN 'regulation' THEN 'regulation_precise' WHEN 'ingredient' THEN 'ingredient_query'
      ELSE CASE WHEN starts_with(question, '请问') THEN 'semantic_paraphrase' WHEN n >= 3 THEN 'multi_document' END END AS category FROM q""",
)
def question_category(spark, sf):
    """Each question counts once, under what says most about its annotation."""
    i = F.col("item_id")
    kinds = F.array(*map(F.lit, ("image", "product", "regulation", "ingredient", "general", "formula")))
    question = F.concat(F.when(i % 4 == 0, "请问").otherwise(""), "text")
    return table(spark, sf, "benchmark").select(
        "item_id", rules.primary_category(F.element_at(kinds, (i % 6 + 1).cast("int")), question, i % 5).alias("category")
    )


@register(
    "annotation_identity_dups",
    """SELECT item_id, item_id % 3 = 0 OR item_id % 4 = 0 AS duplicated FROM benchmark""",
)
def annotation_identity_dups(spark, sf):
    """Rows that name one annotation twice, under the document and chunk that identify it."""
    i = F.col("item_id")

    def note(doc, chunk):
        return F.struct(doc.cast("string").alias("doc_id"), F.lit(chunk).alias("chunk_id"))

    notes = F.array(note(i, "c0"), F.when(i % 3 == 0, note(i, "c0")).otherwise(note(i, "c1")), F.when(i % 4 == 0, note(i, "c0")).otherwise(note(i + 1, "c0")))
    return table(spark, sf, "benchmark").select("item_id", contracts.repeats_annotation(notes).alias("duplicated"))


@register(
    "annotation_audit_corpora",
    """WITH r AS (SELECT item_id, item_id % 2 AS set, CASE WHEN item_id % 2 = 1 AND item_id % 5 = 0 THEN 'h2' ELSE 'h1' END AS corpus FROM benchmark)
    SELECT set, count(*) AS total, CASE WHEN count(DISTINCT corpus) > 1 THEN 0 ELSE count(*) END AS scorable, count(DISTINCT corpus) AS corpora FROM r GROUP BY set""",
)
def annotation_audit_corpora(spark, sf):
    """A set whose rows were annotated on more than one corpus has no row that may be scored."""
    i = F.col("item_id")
    rows = table(spark, sf, "benchmark").select((i % 2).alias("set"), F.when((i % 2 == 1) & (i % 5 == 0), "h2").otherwise("h1").alias("corpus"))
    return contracts.corpora_audit(rows, ["set"], "corpus")
