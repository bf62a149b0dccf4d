"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.staging import new_folder, remove_folder, stage, stage_at

__all__ = ["new_folder", "remove_folder", "stage", "stage_at"]

#: Spark's Java regular expression for one word in the whitespace-delimited sense.
WORD_RE = r"[^\x20\x09-\x0D]+"

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame, passed: list[str], **own) -> DataFrame:
    """The columns ``passed`` as c0, c1, ... and an operator's own columns under their names.

    So no name of the caller's table can clash with an operator's, and dots in names do no harm.
    """
    return df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(passed)], *[v.alias(k) for k, v in own.items()])


def binary_list(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def plain_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def task_count(df: DataFrame) -> int:
    """Shuffle partitions of the session, for operators that set their own."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_of(id_col: str, blocks: int):
    """Block number of a row; equal ids share a block."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int")


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers live on while other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def frees_memory(run):
    """For functions of ``mapInArrow``: releases memory when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped


def frees_group_memory(run):
    """For functions of ``applyInArrow``: releases memory after each group."""

    @functools.wraps(run)
    def wrapped(left, right):
        out = run(left, right)
        release_memory()
        return out

    return wrapped
