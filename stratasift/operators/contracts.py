"""Dataset contracts: reason codes, coverage, samples, reviews and feedback loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratasift.staging import stage

from .ranking import distributed_rank

# A golden row as the contract has it.
_NOTE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "chunk_id", "text")] + [T.StructField("relevance", T.IntegerType())]
)
_PROVENANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("annotator", "method", "annotated_at", "source", "review_status", "reviewed_by")]
)
GOLDEN_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sample_id", "question", "business_type", "difficulty")]
    + [T.StructField("visual_required", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("complexity_label", "corpus_version", "corpus_sha256")]
    + [T.StructField("annotations", T.ArrayType(_NOTE)), T.StructField("annotation", _PROVENANCE)]
)

BUSINESS_TYPES = ("regulation", "ingredient", "formula", "image", "general", "product")
DIFFICULTIES = ("easy", "medium", "hard")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def reasons(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]))


def golden_row_reasons() -> Column:
    """Why a row of :data:`GOLDEN_ROW` may not be scored; empty if it may."""
    notes = F.coalesce(F.col("annotations"), F.array().cast(GOLDEN_ROW["annotations"].dataType))

    def at(code: str, broken) -> Column:
        numbered = F.transform(notes, lambda a, i: F.when(broken(a), F.concat(F.lit("annotation_"), i.cast("string"), F.lit(code))))
        return F.array_compact(numbered)

    row = reasons(
        (blank(F.col("sample_id")), "missing_sample_id"),
        (blank(F.col("question")), "missing_question"),
        (~F.coalesce(F.col("business_type").isin(*BUSINESS_TYPES), F.lit(False)), "invalid_business_type"),
        (~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "invalid_difficulty"),
        (F.col("visual_required").isNull(), "missing_visual_required_label"),
        (~F.coalesce(F.col("complexity_label").isin("simple", "complex"), F.lit(False)), "missing_complexity_label"),
        (~F.coalesce(F.col("corpus_version").rlike("^[A-Za-z0-9_.-]+$"), F.lit(False)), "missing_or_invalid_corpus_version"),
        (F.size(notes) == 0, "missing_annotations"),
    )
    provenance = reasons(
        (F.col("annotation").isNull(), "missing_annotation_provenance"),
        (F.col("annotation").isNotNull() & blank(F.col("annotation.annotator")), "missing_annotation_annotator"),
        (F.col("annotation").isNotNull() & blank(F.col("annotation.reviewed_by")), "missing_annotation_reviewed_by"),
        (
            F.coalesce(F.col("annotation.review_status") != "REVIEWED", F.lit(False)),
            "annotation_not_reviewed",
        ),
        (
            F.col("annotation").isNotNull()
            & ~F.coalesce(F.col("annotation.source").isin("human", "llm_candidate"), F.lit(False)),
            "invalid_annotation_source",
        ),
    )
    return F.concat(
        row,
        at("_missing_doc_id", lambda a: blank(a["doc_id"])),
        at("_missing_chunk_id", lambda a: blank(a["chunk_id"])),
        at("_missing_text", lambda a: blank(a["text"])),
        provenance,
        at("_invalid_relevance_grade", lambda a: ~F.coalesce(a["relevance"].isin(0, 1, 2), F.lit(True))),
    )


def reason_histogram(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_present, share): neither null nor blank, from one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~blank(F.col(f).cast("string"))).alias(f) for f in fields])
    long = one.unpivot(["n"], fields, "field", "n_present")
    return long.select("field", "n_present", F.round(F.try_divide(F.col("n_present"), F.col("n")), 6).alias("share"))


def duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key was seen before, with the place of the first."""
    w = Window.partitionBy(key).orderBy(order)
    return (
        df.select(key, order, F.row_number().over(w).alias("nth"), F.first(order).over(w).alias("first_seen"))
        .where("nth > 1")
        .drop("nth")
    )


def quota(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each category in file order."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("k") <= n).drop("k")


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, or all if they are fewer: in proportion to the strata, one of each at least, topped up from the rest.

    Which ones is up to a hash of their keys.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = distributed_rank(df.withColumn("draw", draw), [by], ["draw", key])
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    wanted = F.greatest(F.lit(1), F.floor(n * F.col("group_size") / F.col("total")))
    judged = stage(ranked.crossJoin(F.broadcast(total)).withColumn("drawn", F.col("rank") <= wanted), "sample")
    drawn = judged.where("drawn")
    # What rounding left over goes to the first of the others, whatever their stratum.
    rest = judged.where(~F.col("drawn")).orderBy("draw", key).limit(max(0, n - drawn.count()))
    return drawn.unionByName(rest).select(*df.columns)


def select_samples(df: DataFrame, key: str, wanted: list, limit: int | None = None) -> DataFrame:
    """Rows with the wanted keys; one that is missing is an error, found before any limit."""
    ids = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} {df.schema[key].dataType.simpleString()}")
    missing = [r[0] for r in ids.join(df, key, "left_anti").limit(10).collect()]
    if missing:
        raise ValueError(f"no such samples: {missing}")
    # The wanted keys are a list of the caller's; Spark broadcasts it if it is small.
    found = df.join(ids, key, "left_semi").orderBy(key)
    return found.limit(limit) if limit else found


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Regrades annotations by signed decisions; a decision without a reviewer of its own is refused.

    Both have (sample_id, key, grade); decisions also ``reviewer`` and ``hash``,
    candidates ``annotator`` and ``hash``.  A null grade takes a passage out.
    """
    d = decisions.select("sample_id", "key", F.col("grade").alias("new_grade"), "reviewer", F.col("hash").alias("signed"))
    joined = candidates.join(d, ["sample_id", "key"], "full_outer")
    refused = (
        F.when(F.col("signed").isNull(), None)
        .when(blank(F.col("reviewer")), "unnamed_reviewer")
        .when(F.col("reviewer") == F.col("annotator"), "self_review")
        .when(F.col("hash").isNotNull() & (F.col("hash") != F.col("signed")), "stale_candidate")
    )
    grade = F.when(F.col("signed").isNull() | refused.isNotNull(), F.col("grade")).otherwise(F.coalesce("new_grade", F.lit(0)))
    return joined.select("sample_id", "key", grade.alias("grade"), refused.alias("refused"))


def drift(declared: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Declared but missing, and tracked but undeclared."""
    return (
        declared.join(tracked, key, "left_anti")
        .select(key, F.lit("missing").alias("problem"))
        .unionByName(tracked.join(declared, key, "left_anti").select(key, F.lit("undeclared").alias("problem")))
    )


def line_matches(
    df: DataFrame, key: str, text_col: str, shapes: list[tuple[str, str]], exempt: Column | None = None, allowed: str | None = None
) -> DataFrame:
    """(key, line, label) of every line that a pattern finds; the patterns are one array of columns, not a join.

    In exempt rows a match that is nothing but an allowed value doesn't count.
    """
    lines = df.select(key, (F.lit(False) if exempt is None else exempt).alias("exempt"), F.posexplode(F.split(text_col, "\n")).alias("i", "x"))

    def found(pattern):
        hit = F.col("x").rlike(pattern)
        if allowed is None:
            return hit
        return hit & ~(F.col("exempt") & F.trim(F.regexp_extract("x", pattern, 0)).rlike(allowed))

    labels = F.array_compact(F.array(*[F.when(found(p), F.lit(label)) for label, p in shapes]))
    return lines.select(key, (F.col("i") + 1).cast("long").alias("line"), F.explode(labels).alias("label"))


def unresolved(annotations: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations whose identifiers the index doesn't have."""
    return annotations.join(index.select(*keys).distinct(), keys, "left_anti").select(*annotations.columns)


def unresolved_chunks(annotations: DataFrame, index: DataFrame, keys: list[str], place: str = "chunk_index", count: str = "n") -> DataFrame:
    """Annotations whose place is not below the number of chunks that the index has for their keys."""
    known = index.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col(count).alias("of_count"))
    there = F.col(place) < F.col("of_count")
    for k in keys:
        there &= F.col(k) == F.col(f"of_{k}")
    return annotations.join(known, there, "left_anti")


def gold_approval(rows: DataFrame, chunk_ids: str, index: DataFrame) -> DataFrame:
    """(chunk_id, verdict) of every chunk that golden rows point at, by ``index(chunk_id, approved)``."""
    asked = rows.select(F.explode(chunk_ids).alias("chunk_id")).where(~blank(F.col("chunk_id"))).distinct()
    verdict = F.when(F.col("approved").isNull(), "not_indexed").when(F.col("approved"), "approved").otherwise("unapproved_source")
    return asked.join(index, "chunk_id", "left").select("chunk_id", verdict.alias("verdict"))


def attributable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of :data:`GOLDEN_ROW` that may be scored, and the others with their ``reasons``."""
    judged = df.withColumn("reasons", golden_row_reasons())
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


#: A legacy dataset with fewer entries is too small.
LEGACY_LEAST = 300


def legacy_errors(df: DataFrame, key: str) -> DataFrame:
    """(key, error) of a dataset in the legacy form; errors of the whole dataset have a null key.

    An entry that lacks a field has no other error.
    """
    fields = ("question", "answer", "contexts", "ground_truth")
    missing = reasons(*[(F.col(f).isNull(), f"missing_{f}") for f in fields])
    blanks = F.transform("contexts", lambda c, i: F.when(blank(c), F.concat(F.lit("blank_context_"), i.cast("string"))))
    others = F.concat(
        reasons(*[(F.trim(f) == "", f"blank_{f}") for f in ("question", "answer", "ground_truth")], (F.size("contexts") == 0, "no_contexts")),
        F.array_compact(blanks),
        reasons(
            (F.col("business_type").isNotNull() & ~F.col("business_type").isin(*BUSINESS_TYPES), "invalid_business_type"),
            (F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(*DIFFICULTIES), "invalid_difficulty"),
        ),
    )
    rows = df.select(key, F.explode(F.when(F.size(missing) > 0, missing).otherwise(others)).alias("error"))
    whole = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("business_type") == b).alias(f"b_{b}") for b in BUSINESS_TYPES],
        *[F.count_if(F.col("difficulty") == d).alias(f"d_{d}") for d in DIFFICULTIES],
    )
    enough = F.col("n") >= LEGACY_LEAST
    codes = reasons(
        (~enough, "too_few_entries"),
        *[(enough & (F.col(f"b_{b}") == 0), f"no_business_type_{b}") for b in BUSINESS_TYPES],
        *[(enough & (F.col(f"d_{d}") == 0), f"no_difficulty_{d}") for d in DIFFICULTIES],
    )
    nobody = F.lit(None).cast(df.schema[key].dataType).alias(key)
    return rows.unionByName(whole.select(nobody, F.explode(codes).alias("error")))


def data_class(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``data_class``, ``claims`` and ``noticed`` by ``manifest(path, class, claims)``; only declared fabricated data is called so."""
    found = df.join(manifest, "path", "left")
    noticed = F.coalesce((F.col("class") == "SYNTHETIC") & ~F.col("claims"), F.lit(False))
    return found.select(*df.columns, F.coalesce("class", F.lit("UNCLASSIFIED")).alias("data_class"), "claims", noticed.alias("noticed"))


def repeats_annotation(notes: Column) -> Column:
    """Whether two annotations of a row name the same document and chunk."""
    keys = F.transform(notes, lambda a: F.struct(a["doc_id"].alias("d"), a["chunk_id"].alias("c")))
    return F.size(keys) != F.size(F.array_distinct(keys))


def corpora_audit(df: DataFrame, by: list[str], corpus: str) -> DataFrame:
    """(``by``, total, scorable, corpora): nothing is scorable if rows belong to more than one corpus."""
    n = F.countDistinct(corpus)
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(total.alias("total"), F.when(n > 1, F.lit(0).cast("long")).otherwise(total).alias("scorable"), n.alias("corpora"))


def answer_rates(df: DataFrame, by: str) -> DataFrame:
    """Per category and over all: rates among answered rows; null where nothing was answered.

    Rows have ``support``, ``answered``, ``high_risk`` and ``leak``.
    """
    answered, risky = F.col("answered"), F.col("answered") & F.col("high_risk")

    def rate(hit: Column, among: Column) -> Column:
        return F.round(F.try_divide(F.count_if(among & hit), F.count_if(among)), 6)

    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("support") == "supported", answered).alias("support_strict"),
        rate(F.col("support") != "unsupported", answered).alias("support_inclusive"),
        F.count_if("leak").alias("rbac_leaks"),
        F.count_if(risky).alias("high_risk_n"),
        rate(F.col("support") == "unsupported", risky).alias("high_risk_unsupported"),
    )


def observation_problems(samples: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): observations of no sample, more than one of a sample, and samples without one."""
    unknown = observed.join(samples, key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    twice = observed.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"))
    missing = samples.join(observed, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return unknown.unionByName(twice).unionByName(missing)


def snapshot_counts(rows: DataFrame, documents: DataFrame, keys: list[str], content: str, epoch: str) -> DataFrame:
    """(check_name, n) of a snapshot's rows against the documents that it should have."""
    doc = keys[0]
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col(content), F.lit("")) == "").alias("blank_content"),
        F.count_if(F.col(epoch).isNull()).alias("missing_epoch"),
    )
    distinct = rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_chunks"))
    there = rows.select(doc).distinct()
    found = there.agg(F.count(F.lit(1)).alias("documents"))
    lacking = documents.select(doc).distinct().join(there, doc, "left_anti").agg(F.count(F.lit(1)).alias("missing_documents"))
    whole = one.crossJoin(distinct).crossJoin(found).crossJoin(lacking)
    return whole.unpivot([], whole.columns, "check_name", "n")


def hash_agreement(truth: DataFrame, index: DataFrame, ledger: DataFrame, key: str, value: str) -> DataFrame:
    """(key, verdict): whether the index and the ledger have the hash of a source's bytes."""
    both = (
        truth.select(key, F.col(value).alias("t"))
        .join(index.select(key, F.col(value).alias("i")), key, "left")
        .join(ledger.select(key, F.col(value).alias("l")), key, "left")
    )
    i, l, t = F.col("i"), F.col("l"), F.col("t")  # noqa: E741
    verdict = (
        F.when(i.isNull(), "not_indexed")
        .when(l.isNull(), "not_in_ledger")
        .when((i != t) & (l != t), "bytes_differ")
        .when(i != t, "index_differs")
        .when(l != t, "ledger_differs")
    )
    return both.select(key, verdict.otherwise("agree").alias("verdict"))


def provenance_reasons() -> Column:
    """What a chunk's provenance lacks, or says against itself."""
    status = F.col("approval_status")
    approved = F.coalesce(status == "APPROVED", F.lit(False))
    return reasons(
        (blank(F.col("source_id")), "missing_source_id"),
        (blank(status), "missing_approval_status"),
        (approved & blank(F.col("approval_actor")), "approved_without_actor"),
        (approved & ~F.col("approved_content_hash").eqNullSafe(F.col("content_hash")), "approved_other_content"),
        ((F.col("trust_class") == "APPROVED_EXTERNAL") & ~approved & ~blank(status), "trusted_without_approval"),
    )
