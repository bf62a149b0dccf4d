"""The feedback cycle as incremental runs with a stored cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.staging import path_exists

PENDING, ACCEPTED, REJECTED = "pending", "accepted", "rejected"

_RUNS = "run int, cursor timestamp, n_new long"
_RECORDS = "feedback_id string, ts timestamp, rating long, corrected boolean, answered boolean, run int"
_DECISIONS = "feedback_id string, status string, revision int, run int"


class FeedbackStore:
    """Records, decisions and runs below one folder, all of them only ever appended.

    A run reads what is newer than the cursor less ``late_s`` seconds, drops
    what the store has, appends the rest and then its cursor.  A run that dies
    before its cursor is written is repeated by the next one, which overwrites
    what it left; a repeated run adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, late_s: int = 86_400):
        self.spark, self.root, self.late_s = spark, root.rstrip("/"), late_s

    def _read(self, part: str, ddl: str) -> DataFrame:
        path = f"{self.root}/{part}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def runs(self) -> DataFrame:
        return self._read("runs", _RUNS)

    def _done(self) -> tuple[int, object]:
        row = self.runs().agg(F.max("run").alias("run"), F.max("cursor").alias("cursor")).first()
        return row["run"] or 0, row["cursor"]

    def records(self) -> DataFrame:
        """Only those of finished runs."""
        return self._read("records", _RECORDS).where(F.col("run") <= self._done()[0])

    def collect(self, log: DataFrame) -> int:
        """One run over a log of (feedback_id, ts, rating, corrected, answered); how many records are new.

        Of rows with one id the earliest counts; rows without an id are dropped.
        """
        done, cursor = self._done()
        fresh = log if cursor is None else log.where(F.col("ts") >= F.lit(cursor) - F.make_dt_interval(secs=F.lit(self.late_s)))
        first = fresh.where("feedback_id is not null").groupBy("feedback_id").agg(F.min(F.struct("ts", "rating", "corrected", "answered")).alias("r"))
        new = first.select("feedback_id", "r.*").join(self.records().select("feedback_id"), "feedback_id", "left_anti")
        path = f"{self.root}/records/run={done + 1}"
        new.write.mode("overwrite").parquet(path)
        # The records carry their run in the folder's name; what was written is what counts.
        written = self.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("cursor")).first()
        newest = max((x for x in (cursor, written["cursor"]) if x is not None), default=None)
        self.spark.createDataFrame([(done + 1, newest, written["n"])], _RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        return written["n"]

    def decide(self, decisions: DataFrame) -> None:
        """Appends (feedback_id, status); the last decision on a record counts, those on unknown records nothing."""
        known = decisions.where(F.col("status").isin(ACCEPTED, REJECTED)).join(self.records().select("feedback_id"), "feedback_id", "left_semi")
        revision = (self._read("decisions", _DECISIONS).agg(F.max("revision")).first()[0] or 0) + 1
        known.select("feedback_id", "status", F.lit(revision).alias("revision"), F.lit(self._done()[0]).alias("run")).write.mode("append").parquet(f"{self.root}/decisions")

    def statuses(self) -> DataFrame:
        last = self._read("decisions", _DECISIONS).groupBy("feedback_id").agg(F.max(F.struct("revision", "status")).alias("d"))
        return self.records().join(last, "feedback_id", "left").withColumn("status", F.coalesce("d.status", F.lit(PENDING))).drop("d")

    def datasets(self) -> DataFrame:
        """(dataset, feedback_id): what accepted records are good for."""
        kinds = {
            "hard_negatives": F.col("rating") <= 0,
            "rewrite_corrections": F.col("corrected"),
            "evaluation": F.col("answered"),
            "preference": F.col("corrected") & F.col("answered"),
        }
        names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
        return self.statuses().where(F.col("status") == ACCEPTED).select(F.explode(names).alias("dataset"), "feedback_id")

    def regression_candidates(self) -> DataFrame:
        """Accepted bad answers become cases to be watched: (case_id, feedback_id)."""
        bad = self.statuses().where((F.col("status") == ACCEPTED) & (F.col("rating") <= 0))
        return bad.select(F.substring(F.sha2(F.concat(F.lit("regression:"), "feedback_id"), 256), 1, 16).alias("case_id"), "feedback_id")
