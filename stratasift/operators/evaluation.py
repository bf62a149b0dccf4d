"""Ranking metrics, latency summaries and experiment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import distributed_rank

DEPTHS = (1, 3, 5, 10)


def dedupe_ranks(ranked: DataFrame, query: str = "query", key: str = "doc", rank: str = "rank") -> DataFrame:
    """Drops a key's later places and makes ranks dense again."""
    best = ranked.groupBy(query, key).agg(F.min(rank).alias(rank))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy(rank, key)))


def score_rankings(gold: DataFrame, ranked: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """One row per query: recall, hit, reciprocal rank, graded NDCG; null where a query has no gold.

    ``gold(query, doc, grade)`` may repeat a key, the highest grade counts.
    Grades below one are no gold.  Gain is linear.
    """
    g = gold.where("grade >= 1").groupBy("query", "doc").agg(F.max("grade").alias("grade"))
    found = g.join(dedupe_ranks(ranked), ["query", "doc"], "left")
    ideal_order = Window.partitionBy("query").orderBy(F.desc("grade"), "doc")
    placed = found.withColumn("ideal", F.row_number().over(ideal_order))
    within = F.col("rank") <= depth

    def gain(place: Column) -> Column:
        return F.col("grade") / F.log2(place + 1)

    per = placed.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_gold"),
        *[
            (F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)) / F.count(F.lit(1))).alias(f"recall_{k}")
            for k in DEPTHS
        ],
        *[F.coalesce(F.max(F.col("rank") <= k), F.lit(False)).alias(f"hit_{k}") for k in DEPTHS],
        F.coalesce(F.max(F.when(within, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.round(
            F.coalesce(F.sum(F.when(within, gain(F.col("rank")))), F.lit(0.0))
            / F.sum(F.when(F.col("ideal") <= depth, gain(F.col("ideal")))),
            6,
        ).alias("ndcg"),
    )
    return queries.join(per, "query", "left")


def metric_block(results: DataFrame, groupings: list[str] | None = None) -> DataFrame:
    """Macro means over queries with gold: overall and by each of ``groupings``, in one pass."""
    dims = groupings or []
    aggregates = [
        F.count(F.lit(1)).alias("n_queries"),
        F.count("n_gold").alias("n_scored"),
        *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in DEPTHS],
        *[F.round(F.avg(F.col(f"hit_{k}").cast("double")), 6).alias(f"hit_{k}") for k in DEPTHS],
        F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
    ]
    if not dims:
        return results.agg(*aggregates)
    return results.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(*aggregates)


def linear_percentiles(value: Column, points=(0.5, 0.9, 0.95, 0.99)) -> list[Column]:
    """Exact, linearly interpolated; null without a value."""
    return [F.round(F.percentile(value, p), 6).alias(f"p{round(p * 100)}") for p in points]


def floor_percentile(sorted_values: Column, p: float) -> Column:
    """The value at index ``min(floor(n p), n - 1)``."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.element_at(sorted_values, (F.least(F.floor(n * p), n - 1) + 1).cast("int")))


def floor_percentiles(df: DataFrame, by: list[str], value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Floor-index percentiles by rank, so that no group's values are in one array or task."""
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"))
    ranked = distributed_rank(known, by, ["value"])

    def at(p):
        index = F.least(F.floor(F.col("group_size") * p), F.col("group_size") - 1) + 1
        return F.round(F.max(F.when(F.col("rank") == index, F.col("value"))), 2).alias(f"p{round(p * 100)}")

    return ranked.groupBy(*by).agg(F.max("group_size").alias("n"), F.round(F.max("value"), 2).alias("max"), *[at(p) for p in points])


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun's 7.1.26."""
    # Coefficients of the approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    p = 0.3275911
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + p * z)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.signum(x) * erf)


def z_test(stats: DataFrame, arm: str, first: str, second: str, by: list[str], least: int = 30) -> DataFrame:
    """Two-sided test of two arms from (mean, var, n) rows; arms below ``least`` give no row.

    ``winner_lower_mean`` is the arm with the smaller mean, as the rule has it
    whatever the metric; ``winner`` takes ``higher_is_better`` into account.
    """
    a = stats.where(F.col(arm) == first).select(*by, *[F.col(c).alias(f"{c}_a") for c in ("mean", "var", "n")])
    b = stats.where(F.col(arm) == second).select(*by, *[F.col(c).alias(f"{c}_b") for c in ("mean", "var", "n")])
    joined = (a.join(b, by) if by else a.crossJoin(b)).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    se = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    z = F.when(se == 0, 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / se)
    p = F.when(se == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.abs(z))))
    return joined.select(
        *by,
        F.round(z, 4).alias("z"),
        F.round(p, 6).alias("p_value"),
        (p < 0.05).alias("significant"),
        F.when(F.col("mean_a") < F.col("mean_b"), first).otherwise(second).alias("winner_lower_mean"),
    )
