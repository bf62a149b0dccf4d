"""Structured Streaming twins of batch queries; ``run_to_table`` drains a stream into a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; a temporary one only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratasift-")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", "1 hour").alias("w")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "event_type", "n"
    )


def sliding_average(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", "6 hours", "1 hour").alias("w")
    return events.withWatermark("ts", late).groupBy(w).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")
    ).select(F.col("w.start").alias("window_start"), "n", "mean")


def session_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", "2 hours").alias("w")
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n_events")).select(
        "user_id", F.col("w.start").alias("session_start"), "n_events"
    )


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def joined_with_static(events: DataFrame, static: DataFrame) -> DataFrame:
    return events.join(static, "user_id")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Processes all that is there, batch by batch, and returns the result as a table in the shared folder.

    ``complete`` overwrites the table with each batch's whole result, ``append`` adds to it.
    """
    spark = stream.sparkSession
    target, checkpoint = shared_folder(spark, "stream"), shared_folder(spark, "progress")

    def write(batch: DataFrame, epoch: int) -> None:
        # A batch that is replayed after a failure replaces what it wrote before.
        path = target if mode == "complete" else f"{target}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    query.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(target)
    return out.select(*stream.columns)


def audit_sink(batch: DataFrame, path: str, keep_days: int = 30) -> None:
    """Writes audit rows by day and leaves out what is older than the retention."""
    newest = batch.agg(F.max("ts").alias("newest"))
    kept = batch.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"interval {keep_days} days"))
    kept.drop("newest").withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
