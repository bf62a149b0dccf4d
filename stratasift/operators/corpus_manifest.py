"""A Merkle manifest of a keyed table, compared by descending instead of by reading all rows.

Every row is a leaf at the address of its key's SHA-256; leaves with the same
first hex digits form a bottom node, and sixteen nodes one above.  Two tables
with equal roots are equal; otherwise only nodes whose digests differ are
opened, and in the end only the leaves below them meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.staging import stage

#: Leaves of a bottom node on average.
NODE_LEAVES = 64

_NODES = "level int, prefix string, n long, digest string"
_LEAVES = "key string, address string, leaf string, facets map<string,string>"


def depth_for(n: int, most: int | None = None) -> int:
    """Levels below the root, so that bottom nodes stay small at any number of rows; ``most`` bounds them."""
    depth = 0
    while n > NODE_LEAVES * 16**depth and depth != most:
        depth += 1
    return depth


def leaves(rows: DataFrame, key: Column, facets: dict[str, Column]) -> DataFrame:
    """(key, address, leaf, facets): each row's digest over its key and what is to be compared; null is told from empty."""
    values = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in facets.values()]
    named = F.create_map(*[x for n, c in facets.items() for x in (F.lit(n), c.cast("string"))])
    text = key.cast("string")
    return rows.select(
        text.alias("key"), F.sha2(text, 256).alias("address"), F.sha2(F.to_json(F.array(text, *values)), 256).alias("leaf"), named.alias("facets")
    )


def node_table(rows: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, n, digest) of all nodes; a level is made of the one below it."""
    level = (
        rows.groupBy(F.substring("address", 1, depth).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ""), 256).alias("digest"))
        .withColumn("level", F.lit(depth))
    )
    out = level = stage(level.select("level", "prefix", "n", "digest"), "nodes")
    for k in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        level = (
            level.groupBy(F.substring("prefix", 1, k).alias("prefix"))
            .agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))
            .select(F.lit(k).alias("level"), "prefix", "n", "digest")
        )
        out = out.unionByName(level)
    return out


class CorpusManifest:
    """A manifest below one folder, written with ``write`` and read by others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, rows: DataFrame, depth: int | None = None, most: int | None = None) -> None:
        """``rows`` are those of :func:`leaves`; a null key or one that occurs twice raises a ValueError."""
        rows.sort("address").write.mode("overwrite").parquet(f"{self.root}/leaves")
        stored = self.leaves()
        one = stored.agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("keys")).first()
        if one["n"] != one["keys"] or stored.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("every row needs a key of its own")
        node_table(stored, depth_for(one["n"], most) if depth is None else depth).write.mode("overwrite").partitionBy("level").parquet(f"{self.root}/nodes")

    def leaves(self) -> DataFrame:
        return self.spark.read.schema(_LEAVES).parquet(f"{self.root}/leaves")

    def nodes(self) -> DataFrame:
        return self.spark.read.schema("prefix string, n long, digest string, level int").parquet(f"{self.root}/nodes").select("level", "prefix", "n", "digest")

    def depth(self) -> int:
        return self.nodes().agg(F.max("level")).first()[0] or 0

    def root_digest(self) -> str | None:
        """Null for an empty table."""
        row = self.nodes().where("level = 0").first()
        return row and row["digest"]


def open_nodes(mine: CorpusManifest, theirs: CorpusManifest) -> DataFrame:
    """(prefix) of the bottom nodes that differ; on the way down only nodes below differing ones are read."""
    depth = mine.depth()
    if depth != theirs.depth():
        raise ValueError("manifests are compared at the same depth: write the second with the first one's")
    found = None
    for level in range(depth + 1):
        a, b = (m.nodes().where(F.col("level") == level).select("prefix", "digest") for m in (mine, theirs))
        if found is not None:
            parent = F.substring("prefix", 1, level - 1)
            a, b = (x.join(found.select(F.col("prefix").alias("parent")), parent == F.col("parent"), "left_semi") for x in (a, b))
        both = a.join(b.withColumnRenamed("digest", "other"), "prefix", "full")
        found = stage(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix"), "open")
    return found


def differences(mine: CorpusManifest, theirs: CorpusManifest) -> DataFrame:
    """(key, problem, facets): what is missing from theirs, unexpected there, or differs, with the names of what differs."""
    depth, below = mine.depth(), open_nodes(mine, theirs)

    def side(manifest: CorpusManifest, name: str) -> DataFrame:
        near = manifest.leaves().withColumn("prefix", F.substring("address", 1, depth)).join(below, "prefix", "left_semi")
        return near.select("key", F.col("leaf").alias(f"{name}_leaf"), F.col("facets").alias(f"{name}_facets"))

    both = side(mine, "my").join(side(theirs, "their"), "key", "full").where(~F.col("my_leaf").eqNullSafe(F.col("their_leaf")))
    names = F.filter(F.map_keys("my_facets"), lambda k: ~F.col("my_facets")[k].eqNullSafe(F.col("their_facets")[k]))
    problem = F.when(F.col("their_leaf").isNull(), "missing").when(F.col("my_leaf").isNull(), "unexpected").otherwise("changed")
    return both.select("key", problem.alias("problem"), F.when(F.col("my_leaf").isNotNull() & F.col("their_leaf").isNotNull(), F.array_sort(names)).otherwise(F.array()).alias("facets"))
