"""Immutable epoch snapshots, JSON-lines exports and values as files."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Files in one folder of those that :func:`write_each` writes; more than a few folders are listed in parallel.
FOLDER_FILES = 1_000


class SealedEpochError(RuntimeError):
    """An epoch that is sealed is read-only."""


class EpochStore:
    """Chunks partitioned by epoch below one folder, with a manifest of sealed epochs beside them."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, epoch_col: str = "doc_version_epoch"):
        self.spark, self.root, self.schema, self.epoch_col = spark, root.rstrip("/"), schema, epoch_col

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def sealed(self) -> DataFrame:
        path = f"{self.root}/manifest"
        ddl = "epoch string, n_rows long, digest long"
        if not self._exists(path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def _writable(self, epoch: str) -> None:
        if self.sealed().where(F.col("epoch") == epoch).limit(1).count():
            raise SealedEpochError(epoch)

    def read(self, epoch: str) -> DataFrame:
        """Only the epoch's own folder is listed and read."""
        path = f"{self.root}/chunks/{self.epoch_col}={epoch}"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path).withColumn(self.epoch_col, F.lit(epoch)).select(*self.schema.names)

    def replace(self, epoch: str, rows: DataFrame) -> None:
        """Writes the whole epoch; the mapping is checked first."""
        self._writable(epoch)
        got = {f.name: f.dataType for f in rows.schema}
        want = {f.name: f.dataType for f in self.schema}
        if got != want:
            raise ValueError(f"schema differs: {sorted(set(got.items()) ^ set(want.items()), key=str)}")
        rows.drop(self.epoch_col).write.mode("overwrite").parquet(f"{self.root}/chunks/{self.epoch_col}={epoch}")

    def seal(self, epoch: str) -> None:
        """Appends the epoch, its size and an order-independent checksum to the manifest."""
        self._writable(epoch)
        rows = self.read(epoch)
        one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("digest"))
        one.select(F.lit(epoch).alias("epoch"), "n_rows", "digest").write.mode("append").parquet(f"{self.root}/manifest")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; empty if both are equal as multisets."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def export_json_lines(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines; a fixed number of files only for exports known to be small."""
    (df.coalesce(files) if files else df).write.mode("overwrite").json(path)


def write_artifact(one: DataFrame, folder: str, parts: tuple[str, ...]) -> None:
    """One JSON file for each part of a one-row table, with the columns that begin with its name; nulls are written out."""
    for part in parts:
        fields = [F.col(c).alias(c.removeprefix(f"{part}_")) for c in one.columns if c.startswith(f"{part}_")]
        export = one.select(*fields).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false")
        export.json(f"{folder}/{part}")


def read_artifact(spark: SparkSession, folder: str, parts: tuple[str, ...]) -> DataFrame:
    """(part, field, value) of an artifact's files; what was not measured is null."""
    found = None
    for part in parts:
        values = F.from_json("value", "map<string,double>")
        rows = spark.read.text(f"{folder}/{part}").select(F.lit(part).alias("part"), F.explode(values).alias("field", "value"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder in a file system that is mounted; None for any other store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return target.toUri().getPath() if store.getUri().getScheme() == "file" else None


def _write_files(values: Iterable[bytes | None], path: str, end: bytes, part: int, attempt: int) -> int:
    """Writes a task's files to a folder that readers pass over; it gets its name when all are there.

    Of several attempts at one part, the first to end counts.
    """
    own, n = f"{path}/_{part:05d}-{attempt}", 0
    for value in values:
        if n % FOLDER_FILES == 0:
            os.makedirs(folder := f"{own}/{n // FOLDER_FILES:05d}")
        with open(f"{folder}/part-{part:05d}-{n:07d}.txt", "wb") as f:
            f.write((value or b"") + end)
        n += 1
    if n:
        try:
            os.rename(own, f"{path}/{part:05d}")
        except OSError:
            if not os.path.isdir(f"{path}/{part:05d}"):
                raise
            shutil.rmtree(own)
    return n


def write_each(values: DataFrame, folder: str, end: str = "\n") -> None:
    """Every value of the only column becomes a text file below a new folder, and ``end`` ends it; null is an empty value.

    Spark's writer starts processes for every file that it creates in a local file system without native libraries, which takes
    hundreds of times as long as the file. There the tasks write the files themselves; elsewhere Spark's text writer does.
    """
    spark, (name,) = values.sparkSession, values.columns
    if (path := _local_path(spark, folder)) is None:
        values.select(F.col(name).cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", 1).text(folder)
        return
    os.makedirs(path)
    last = end.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        n = _write_files((x.as_py() for b in batches for x in b.column(0)), path, last, task.partitionId(), task.taskAttemptId())
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    values.select(F.col(name).cast("binary").alias("value")).mapInArrow(run, "files long").collect()
