"""From recalled documents to gated answers, for all questions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import rules, text
from stratasift.staging import stage

from . import fusion
from .lexical import top_k

#: Paths that simple questions use; complex ones use all.
SIMPLE_PATHS = ("dense_bge", "bm25_es")

#: Questions with fewer fused documents get fallback rows.
LEAST_FUSED = 50

#: Documents that are reranked, and that count as evidence.
RERANKED, EVIDENCE = 30, 3

#: Characters of a document that are compared with others.
COMPARED = 512


def enabled_paths(recalled: DataFrame, questions: DataFrame, simple: tuple[str, ...] = SIMPLE_PATHS) -> DataFrame:
    """(path, query, doc, rank, is_regulation): rows of the paths that each question uses."""
    asked = questions.select("query", "is_regulation", "is_complex")
    rows = recalled.join(asked, "query").where(F.col("is_complex") | F.col("path").isin(*simple))
    return rows.select("path", "query", "doc", "rank", "is_regulation")


def fused_by_question(rows: DataFrame, k: int = fusion.RRF_K) -> DataFrame:
    """(query, doc, score, n_paths, rank): fusion with the weights that each question asks for."""
    flags = rows.select("query", "is_regulation").distinct()
    best = fusion.best_per_document(rows.select("path", "query", "doc", "rank")).join(flags, "query")
    weight = F.lit(1.0)
    for regulation in (True, False):
        weights = fusion.query_weights(regulation, False)
        for path in fusion.PATH_ALIASES:
            weight = F.when((F.col("path") == path) & (F.col("is_regulation") == regulation), fusion.path_weight(path, weights)).otherwise(weight)
    fused = best.groupBy("query", "doc").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("n_paths"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("n_paths"), "doc")
    return fused.withColumn("rank", F.row_number().over(order))


def consistency(top: DataFrame) -> DataFrame:
    """(query, consistency) of (query, rank, head): the share of pairs of texts that don't contradict each other; 1 without pairs."""
    a, b = top.select("query", "rank", "head"), top.select("query", F.col("rank").alias("rank_b"), F.col("head").alias("head_b"))
    pairs = a.join(b, "query").where("rank < rank_b")  # EVIDENCE rows for each question
    against, _ = text.overlap_entailment(F.col("head"), F.col("head_b"))
    return pairs.groupBy("query").agg((1 - F.avg((against > 0.5).cast("double"))).alias("consistency"))


def answer_questions(
    questions: DataFrame,
    recalled: DataFrame,
    fallback: DataFrame,
    visible: DataFrame,
    bodies: DataFrame,
    rerank: Callable[[Column, Column], Column],
    generate: Callable[[Column, Column], Column],
    least: int = LEAST_FUSED,
) -> DataFrame:
    """One row per question: what was recalled, the evidence, the answer's verdict and the outcome.

    ``questions(query, text, is_regulation, is_complex, conservative)``,
    ``recalled(path, query, doc, rank)``, ``fallback(query, doc, rank)``,
    ``visible(doc)`` for the caller's permissions and ``bodies(doc, body)``.
    ``rerank`` scores a question and a body, ``generate`` makes an answer of
    them; both are columns, as models are plugged in through Arrow functions.

    Paths are chosen by question, fused and filtered by permissions; questions
    that are short of documents get fallback rows, which are filtered as well.
    The best ``RERANKED`` are scored, the best ``EVIDENCE`` pass the evidence
    gate or not, an answer is only made of evidence that passed, and locked
    documents are checked against the permissions once more.
    """
    rows = enabled_paths(recalled, questions)
    fused = fused_by_question(rows).join(visible, "doc", "left_semi")
    order = Window.partitionBy("query").orderBy("rank")
    fused = fused.withColumn("rank", F.row_number().over(order))
    both = stage(fusion.with_fallback(fused, fallback.join(visible, "doc", "left_semi"), least), "candidates")
    candidates = both.where(F.col("rank") <= RERANKED).join(questions.select("query", F.col("text").alias("question")), "query").join(bodies, "doc")
    scored = candidates.select("query", "doc", "question", "body", F.round(rerank(F.col("question"), F.col("body")), 6).alias("score"))
    # Scores are costly and used several times.
    top = stage(top_k(scored, EVIDENCE), "evidence").withColumn("head", F.substring("body", 1, COMPARED))
    first = F.col("rank") == 1
    gathered = top.groupBy("query").agg(
        F.max(F.when(first, F.col("score"))).alias("top1"),
        F.avg("score").alias("mean3"),
        F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("docs"),
        F.max(F.when(first, F.struct("question", "body"))).alias("best"),
    )
    agreement = fusion.path_agreement(rows.where("rank <= 10").select("path", "query", "doc", "rank"))
    counts = both.groupBy("query").agg(F.count(F.lit(1)).alias("n_recalled"), F.count_if(F.col("origin") == "fallback").alias("n_fallback"))
    joined = (
        questions.join(counts, "query", "left").join(gathered, "query", "left").join(agreement, "query", "left").join(consistency(top), "query", "left")
    )
    agreed = F.coalesce("agreement", F.lit(0.0))
    evidence = rules.evidence_score(0.4 * F.col("top1") + 0.3 * F.col("mean3") + 0.2 * agreed + 0.1 * F.coalesce("consistency", F.lit(1.0)))
    gated = joined.withColumn("evidence", F.coalesce(evidence, F.lit(0.0)))
    gated = gated.withColumn("decision", rules.evidence_decision(F.col("evidence"), agreed, F.col("conservative")))
    open_gate = (F.col("decision") != "reject") & F.col("best").isNotNull()
    answered = gated.withColumn("answer", F.when(open_gate, generate(F.col("best.question"), F.col("best.body"))))
    against, _ = text.overlap_entailment(F.col("best.body"), F.col("answer"))
    similar = F.round(text.ngram_jaccard(F.substring("answer", 1, 500), F.substring("best.body", 1, 500)), 6)
    measured = stage(answered.withColumns({"similar": similar, "against": against}), "answers")
    passed, warned = rules.answer_verdict(F.col("similar"), F.col("against"), F.col("is_regulation"), F.col("best").isNotNull())
    judged = measured.withColumn("passed", F.when(F.col("answer").isNotNull(), passed)).withColumn("warned", F.when(F.col("answer").isNotNull(), warned))
    # What the answer rests on has to be visible still when it is given.
    locked = judged.where("passed").select("query", F.explode("docs").alias("d")).select("query", "d.rank", "d.doc").join(visible, "doc", "left_semi")
    named = locked.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"].cast("string")), ",").alias("locked"))
    outcome = rules.request_outcome(F.col("passed"), F.col("decision"), F.lit(False), F.col("answer").isNotNull(), F.lit(None).cast("string"))
    return judged.join(named, "query", "left").select(
        "query",
        F.coalesce("n_recalled", F.lit(0)).alias("n_recalled"),
        F.coalesce("n_fallback", F.lit(0)).alias("n_fallback"),
        "evidence",
        "decision",
        "answer",
        "passed",
        "warned",
        "locked",
        outcome.alias("outcome"),
    )
