"""One verification of an index's sources: completeness, epoch, provenance, ledger, bytes and what gold rows rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import provenance_reasons

#: Statuses under which a source may be active.
APPROVED = "APPROVED"


def source_verdicts(chunks: DataFrame, ledger: DataFrame, files: DataFrame, expected_epoch: str) -> DataFrame:
    """(source_id, n_chunks, codes, verified): each source of the index with all that speaks against it.

    ``chunks`` has chunk_id, source_id, epoch and the columns of a provenance,
    ``ledger`` source_id, status and hash, ``files`` source_id and hash.  A
    source is verified if no code is left; chunks without a source are one
    source of their own, which is null and never verified.  Chunks are reduced
    to one row a source before anything is joined.
    """
    codes = F.array_union(provenance_reasons(), F.array_compact(F.array(F.when(~F.col("epoch").eqNullSafe(F.lit(expected_epoch)), "other_epoch"))))
    marked = chunks.withColumn("code", F.explode_outer(codes))
    counted = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("content_hash").alias("low"), F.max("content_hash").alias("high"))
    found = marked.groupBy("source_id").agg(F.collect_set("code").alias("own_codes"))
    one = counted.join(found, counted["source_id"].eqNullSafe(found["source_id"])).drop(found["source_id"])
    decided = ledger.select("source_id", F.col("status").alias("ledger_status"), F.col("hash").alias("ledger_hash"))
    bytes_of = files.select("source_id", F.col("hash").alias("file_hash"))
    whole = one.join(decided, "source_id", "left").join(bytes_of, "source_id", "left")
    same = F.col("low") == F.col("high")
    against = F.array(
        F.when(F.col("source_id").isNull(), "no_source"),
        F.when(~same, "hash_varies_within_source"),
        F.when(F.col("ledger_hash").isNull(), "not_in_ledger"),
        F.when(F.col("ledger_status") != APPROVED, "not_approved_in_ledger"),
        F.when(same & (F.col("ledger_hash") != F.col("low")), "ledger_hash_differs"),
        F.when(F.col("file_hash").isNull(), "source_file_missing"),
        F.when(same & (F.col("file_hash") != F.col("low")), "file_hash_differs"),
    )
    every = F.array_sort(F.array_union("own_codes", F.array_compact(against)))
    return whole.select("source_id", "n_chunks", every.alias("codes")).withColumn("verified", F.size("codes") == 0)


def gold_problems(chunks: DataFrame, verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """(chunk_id, code) of gold chunks that are not in the index or whose source is not verified."""
    known = chunks.select("chunk_id", "source_id")
    asked = gold.select("chunk_id").distinct().join(known.withColumn("there", F.lit(True)), "chunk_id", "left")
    sound = verdicts.where("verified").select("source_id", F.lit(True).alias("sound"))
    both = asked.join(sound, "source_id", "left")
    code = F.when(F.col("there").isNull(), "gold_chunk_not_indexed").when(F.col("sound").isNull(), "gold_chunk_unverified_source")
    return both.select("chunk_id", code.alias("code")).where("code is not null")


def approval_report(chunks: DataFrame, ledger: DataFrame, files: DataFrame, gold: DataFrame, expected_epoch: str, declared: DataFrame, staged: bool = False) -> DataFrame:
    """(code, n): every problem with how many sources or gold chunks it has, and one row ``verified`` with 1 or 0.

    ``declared(n)`` is how many chunks the index says it has; an index that was
    not read whole, has none, or was built for staging verifies nothing.
    """
    verdicts = source_verdicts(chunks, ledger, files, expected_epoch)
    issues = verdicts.select(F.explode("codes").alias("code")).unionByName(gold_problems(chunks, verdicts, gold).select("code"))
    read = chunks.agg(F.count(F.lit(1)).alias("read")).crossJoin(F.broadcast(declared))  # one row each
    whole = read.select(
        F.explode(F.array_compact(F.array(F.when(F.col("read") != F.col("n"), "index_read_incomplete"), F.when(F.col("read") == 0, "index_is_empty"), F.when(F.lit(staged), "built_for_staging")))).alias("code")
    )
    counts = issues.unionByName(whole).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.lit("verified").alias("code"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("n"))
    return counts.unionByName(total)
