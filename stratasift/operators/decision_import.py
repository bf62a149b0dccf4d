"""Import of signed review decisions, as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.sources.publication import Publication

#: What a reviewer may decide.
VERDICTS = ("ACCEPT", "MODIFY", "REJECT")


def _blank(c):
    return F.coalesce(F.trim(c) == "", F.lit(True))


def judged(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates and decisions side by side, with ``refusal``: why a decision cannot be applied.

    ``candidates`` has sample_id, grade, annotator and hash, ``decisions`` has
    sample_id, verdict, grade, reviewer and hash.  A candidate without a
    decision is unsigned, which is no reason to refuse.
    """
    c = candidates.select("sample_id", F.col("grade").alias("old_grade"), "annotator", F.col("hash").alias("own_hash"), F.lit(True).alias("known"))
    d = decisions.select("sample_id", "verdict", F.col("grade").alias("new_grade"), "reviewer", F.col("hash").alias("signed_hash"), F.lit(True).alias("decided"))
    own = c.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_candidates"), *[F.first(x).alias(x) for x in c.columns[1:]])
    made = d.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_decisions"), *[F.first(x).alias(x) for x in d.columns[1:]])
    both = own.join(made, "sample_id", "full")
    signed = F.col("verdict").isNotNull() & (F.trim("verdict") != "")
    refusal = (
        F.when(F.col("n_candidates") > 1, "candidate occurs more than once")
        .when(F.col("n_decisions") > 1, "more than one decision")
        .when(F.col("known").isNull(), "no such candidate")
        .when(F.col("decided").isNull() | ~F.coalesce(signed, F.lit(False)), None)
        .when(~F.upper("verdict").isin(*VERDICTS), "unknown verdict")
        .when(_blank(F.col("reviewer")), "no named reviewer")
        .when(F.col("reviewer") == F.col("annotator"), "reviewer is the annotator")
        .when(~F.col("signed_hash").eqNullSafe(F.col("own_hash")), "signed for another candidate")
        .when((F.upper("verdict") == "MODIFY") & F.col("new_grade").isNull(), "modified without a value")
    )
    return both.withColumn("refusal", refusal).withColumn("verdict", F.when(signed, F.upper("verdict")).otherwise("UNSIGNED"))


def import_decisions(candidates: DataFrame, decisions: DataFrame, target: Publication, apply: bool = True) -> DataFrame:
    """Publishes reviewed, draft and rejected rows and the ledger of decisions, and returns the refusals.

    (sample_id, refusal): with any refusal nothing is published, and what was
    published before stays as it is.  With ``apply=False`` nothing is written
    either way.
    """
    rows = judged(candidates, decisions)
    refusals = rows.where("refusal is not null").select("sample_id", "refusal")
    grade = F.when(F.col("verdict") == "MODIFY", F.col("new_grade")).otherwise(F.col("old_grade"))
    record = rows.where("known").select("sample_id", grade.alias("grade"), "annotator", "reviewer", "verdict")
    tables = {
        "reviewed": record.where("verdict in ('ACCEPT', 'MODIFY')").drop("verdict"),
        "drafts": record.where("verdict = 'UNSIGNED'").select("sample_id", "grade", "annotator"),
        "rejected": record.where("verdict = 'REJECT'").drop("verdict"),
        "ledger": record.select("sample_id", "verdict"),
    }
    if apply:
        target.publish(tables, refusals)
    return refusals
