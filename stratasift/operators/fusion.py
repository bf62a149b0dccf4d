"""Fusion of several ranked lists, agreement between them, and fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60

# Path names and the weights under which they may be configured.
PATH_ALIASES = {
    "dense_bge": ["dense_bge", "dense", "w_text"],
    "bm25_es": ["bm25_es", "bm25", "w_bm25"],
    "clip_visual": ["clip_visual", "clip", "w_image"],
}


def path_weight(path: str, weights: dict[str, float]) -> float:
    """Weight of a path under any of its names; 1 if none is given."""
    for name in PATH_ALIASES.get(path, [path]):
        if name in weights:
            return float(weights[name])
    return 1.0


def query_weights(is_regulation: bool, is_visual: bool) -> dict[str, float]:
    out = {"dense_bge": 1.0, "bm25_es": 1.5 if is_regulation else 1.0, "clip_visual": 2.0 if is_visual else 1.0}
    return out


def union_paths(paths: dict[str, DataFrame]) -> DataFrame:
    """(path, query, doc, rank) of all paths."""
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("path"), "query", "doc", "rank") for name, df in paths.items()],
    )


def best_per_document(ranked: DataFrame) -> DataFrame:
    """Each path's best place of a document; places are then dense again."""
    best = ranked.groupBy("path", "query", "doc").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("path", "query").orderBy("rank", "doc")
    return best.withColumn("rank", F.row_number().over(w))


def reciprocal_rank_fusion(ranked: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query, doc, score, n_paths, rank) from (path, query, doc, rank).

    Ties go to the document that more paths found, then to the smaller one.
    """
    weight = F.lit(1.0)
    for path in PATH_ALIASES | dict.fromkeys(weights):
        weight = F.when(F.col("path") == path, path_weight(path, weights)).otherwise(weight)
    fused = (
        best_per_document(ranked)
        .groupBy("query", "doc")
        .agg(
            F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"),
            F.count(F.lit(1)).alias("n_paths"),
        )
    )
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("n_paths"), "doc")
    return fused.withColumn("rank", F.row_number().over(w))


def union_first_wins(ranked: DataFrame, order: list[str]) -> DataFrame:
    """One row per query and document: of the first path that has it, at its best place."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("path"))
    w = Window.partitionBy("query", "doc").orderBy(place, "rank")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def path_agreement(ranked: DataFrame, depth: int = 10) -> DataFrame:
    """(query, agreement): mean Jaccard similarity of the top sets of all pairs of paths."""
    tops = ranked.where(F.col("rank") <= depth).groupBy("query", "path").agg(F.collect_set("doc").alias("docs"))
    a, b = tops.alias("a"), tops.select("query", F.col("path").alias("other"), F.col("docs").alias("others"))
    pairs = a.join(b, "query").where(F.col("path") < F.col("other"))
    share = F.size(F.array_intersect("docs", "others")) / F.size(F.array_union("docs", "others"))
    return pairs.groupBy("query").agg(F.round(F.avg(share), 6).alias("agreement"))


def rank_entropy(ranked: DataFrame, clusters: int = 4) -> DataFrame:
    """(query, concentration): one minus the normalised entropy of documents over stable hash clusters."""
    c = ranked.select("query", F.pmod(F.xxhash64("doc"), F.lit(clusters)).alias("c"), "doc").distinct()
    n = c.groupBy("query", "c").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("query"))
    p = n.withColumn("total", total).withColumn("p", F.col("n") / F.col("total"))
    return p.groupBy("query").agg(
        F.when(F.max("total") < 4, 0.5)
        .otherwise(F.round(1 + F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(clusters))), 6))
        .alias("concentration")
    )


def with_fallback(fused: DataFrame, fallback: DataFrame, least: int = 50) -> DataFrame:
    """Appends a query's fallback rows, unfused, where fusion found fewer than ``least`` documents."""
    counts = fused.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    short = fallback.join(counts, "query", "left").where(F.coalesce("n", F.lit(0)) < least)
    new = short.join(fused.select("query", "doc"), ["query", "doc"], "left_anti")
    w = Window.partitionBy("query").orderBy("rank", "doc")
    appended = new.withColumn("rank", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    return fused.select("query", "doc", "rank", F.lit("fused").alias("origin")).unionByName(
        appended.select("query", "doc", "rank", F.lit("fallback").alias("origin"))
    )
