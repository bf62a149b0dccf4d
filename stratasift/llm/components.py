"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_folder, stage_at


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (two columns of one orderable type).

    The component is its smallest node.  Loops and repeated edges do no harm.
    Each round is a staged table, removed when the next one is there; the
    driver sees a count and a checksum of it.
    """
    a, b = edges.columns
    current, folder = stage_at(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges"
    )
    state = _state(current)
    if not state[0]:
        return current.toDF("node", "component")
    while True:
        last = folder
        current, folder = stage_at(_small_star(_large_star(current)), "edges")
        remove_folder(edges.sparkSession, last)
        new = _state(current)
        if new == state:
            break
        state = new
    stars = current.toDF("node", "component")
    return stars.union(stars.select("component", "component").distinct())
