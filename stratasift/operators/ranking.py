"""Ranks within few large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.staging import stage


def distributed_rank(df: DataFrame, by: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Adds ``rank`` (from 1) and ``group_size`` within each group of ``by``, in the order of the columns ``order``.

    Rows are range-partitioned on group and order; each partition numbers its
    own rows, and the partitions' counts, a row for each partition and group,
    say where each begins.  ``order`` must tell all rows of a group apart,
    unless ties may have any order.
    """
    groups, places = [f"g{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))]
    keyed = df.select(
        F.struct(*df.columns).alias("row"), *[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], *[F.col(c).alias(o) for c, o in zip(order, places, strict=True)]
    )
    ranged = keyed.repartitionByRange(*groups, *places).withColumn("part", F.spark_partition_id())
    # Partitions must be the same whenever they are read.
    rows = stage(ranged, "ranges")
    counts = rows.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*groups)
    begins = counts.select(
        *[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("of_part"), (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("begin"), F.sum("n").over(group).alias("group_size")
    )
    own = Window.partitionBy(*groups, "part").orderBy(*places)
    same = F.col("part") == F.col("of_part")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    numbered = rows.withColumn("k", F.row_number().over(own)).join(begins, same)
    return numbered.select("row.*", (F.col("begin") + F.col("k")).alias(rank), "group_size")
