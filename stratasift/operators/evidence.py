"""What stands behind published figures: metrics that reproduce, data files that are declared, batches that were measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import access

#: Batches that statistics are taken from.
RING = 1000

# Levels of trust that a rule may claim.
TRUST_LEVELS = ("MANAGED_INTERNAL", "UNTRUSTED")


def metric_mismatches(published: DataFrame, recomputed: DataFrame, tolerance: float, exact: tuple[str, ...] = ("sample_count", "scored_sample_count")) -> DataFrame:
    """(metric, published, recomputed, problem) of published metrics that do not reproduce.

    Both tables have metric and value.  Counts must be equal, other metrics lie
    within the tolerance; a metric that cannot be recomputed is a problem, one
    that was published as null was not measured and is none.
    """
    if tolerance < 0:
        raise ValueError("a tolerance is not negative")
    mine = published.where("value is not null").select("metric", F.col("value").alias("published"))
    both = mine.join(recomputed.select("metric", F.col("value").alias("recomputed")), "metric", "left")
    allowed = F.when(F.col("metric").isin(*exact), 0.0).otherwise(tolerance)
    problem = F.when(F.col("recomputed").isNull(), "not_recomputed").when(F.abs(F.col("published") - F.col("recomputed")) > allowed, "differs")
    return both.withColumn("problem", problem).where("problem is not null")


def metric_table(results: DataFrame, means: list[str], scored: str) -> DataFrame:
    """(metric, value) over per-query results: counts of all and of those with ``scored``, and macro means of the others."""
    one = results.agg(
        F.count(F.lit(1)).cast("double").alias("sample_count"),
        F.count(scored).cast("double").alias("scored_sample_count"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in means],
    )
    return one.unpivot([], one.columns, "metric", "value")


def manifest_problems(assets: DataFrame, tracked: DataFrame, classes: list[str], inventory: DataFrame, marked: str = "SYNTHETIC") -> DataFrame:
    """(path, problem) of a manifest of data files against what is there.

    ``assets`` has path, class and marker, ``tracked`` and ``inventory`` path.
    An asset is incomplete without path or class, may have a class that nobody
    declared, be missing, lack the marker that its class needs or name one that
    is not there, or be left out of the inventory; a tracked file may have no
    asset.
    """
    numbered = assets.select("path", F.col("class").alias("kind"), "marker")
    incomplete = F.coalesce(F.col("path") == "", F.lit(True)) | F.coalesce(F.col("kind") == "", F.lit(True))
    whole = numbered.where(~incomplete)
    files = tracked.select(F.col("path").alias("file")).distinct()
    listed = inventory.select(F.col("path").alias("listed")).distinct()
    seen = (
        whole.join(files, F.col("path") == F.col("file"), "left")
        .join(files.withColumnRenamed("file", "marker_file"), F.col("marker") == F.col("marker_file"), "left")
        .join(listed, F.col("path") == F.col("listed"), "left")
    )
    codes = F.array_compact(
        F.array(
            F.when(~F.col("kind").isin(*classes), "undeclared_class"),
            F.when(F.col("file").isNull(), "missing"),
            F.when((F.col("kind") == marked) & F.coalesce(F.col("marker") == "", F.lit(True)), "no_marker"),
            F.when(F.coalesce(F.col("marker") != "", F.lit(False)) & F.col("marker_file").isNull(), "marker_absent"),
            F.when(F.col("listed").isNull(), "not_in_inventory"),
        )
    )
    undeclared = files.join(whole, F.col("file") == F.col("path"), "left_anti").select(F.col("file").alias("path"), F.lit("undeclared").alias("problem"))
    return (
        seen.select("path", F.explode(codes).alias("problem"))
        .unionByName(numbered.where(incomplete).select("path", F.lit("incomplete").alias("problem")))
        .unionByName(undeclared)
    )


def publication_blockers(results: DataFrame, attributable: Column, synthetic: Column, approval: DataFrame) -> DataFrame:
    """(place, blocker): everything that forbids to publish a run, the most specific first.

    ``results`` has one row for each configuration with ``executed`` and what
    ``attributable`` and ``synthetic`` look at, ``approval`` is a report of
    (code, n) whose row ``verified`` says whether the sources are approved.
    """
    one = results.agg(
        F.coalesce(F.bool_or("executed"), F.lit(False)).alias("any"),
        F.coalesce(F.bool_and(attributable), F.lit(False)).alias("attributable"),
        F.coalesce(F.bool_or(synthetic), F.lit(False)).alias("synthetic"),
    )
    named = F.concat("code", F.lit("×"), F.col("n").cast("string"))
    report = approval.agg(
        F.coalesce(F.bool_or((F.col("code") == "verified") & (F.col("n") == 1)), F.lit(False)).alias("verified"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("code") != "verified", named))), ", ").alias("detail"),
    )
    detail = F.when(F.col("detail") == "", "no evidence collected").otherwise(F.col("detail"))
    blockers = F.array_compact(
        F.array(
            F.when(~F.col("any"), "no_configuration_executed"),
            F.when(~F.col("attributable"), "dataset_not_attributable"),
            F.when(F.col("synthetic"), "synthetic_retriever"),
            F.when(~F.col("verified"), F.concat(F.lit("source_approval_not_verified: "), detail)),
        )
    )
    return one.crossJoin(report).select(F.posexplode(blockers).alias("place", "blocker"))  # one row each


def batch_statistics(batches: DataFrame, by: str, order: list[str], largest: int) -> DataFrame:
    """Statistics of each group's last ``RING`` batches, and totals of all.

    ``batches`` has items, queue_ms and inference_ms.  Percentiles take the
    value at the floor of their place, as the last one if that is beyond.
    """
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    ring = batches.withColumn("from_end", F.row_number().over(newest)).where(F.col("from_end") <= RING)
    wall = F.col("queue_ms") + F.col("inference_ms")

    def at(values, share):
        place = F.least(F.floor(F.size(values) * share).cast("int"), F.size(values) - 1)
        return F.get(values, place)

    kept = ring.groupBy(by).agg(
        F.avg("items").alias("mean_items"),
        F.array_sort(F.collect_list("queue_ms")).alias("queues"),
        F.array_sort(F.collect_list(wall)).alias("walls"),
        F.avg(F.when(wall > 0, F.col("inference_ms") / wall)).alias("busy"),
    )
    totals = batches.groupBy(by).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("items").alias("n_items"))
    return totals.join(kept, by).select(
        by,
        "n_batches",
        "n_items",
        F.round(F.col("mean_items") / largest, 6).alias("fill_rate"),
        at(F.col("queues"), 0.5).alias("queue_p50"),
        at(F.col("queues"), 0.99).alias("queue_p99"),
        at(F.col("walls"), 0.99).alias("delay_p99"),
        F.round(F.coalesce("busy", F.lit(0.0)), 6).alias("utilisation"),
    )


def trust_claim(path: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The claim of the first pattern that fits a path, with or without a slash before it.

    A missing default and an unknown level raise a ValueError: nobody inherits
    trust by leaving something out.
    """
    if default is None:
        raise ValueError("trust rules need a default")
    if unknown := sorted({level for _, level in rules if level not in TRUST_LEVELS} | ({default} - set(TRUST_LEVELS))):
        raise ValueError(f"unknown levels of trust: {unknown}")
    claim = F.lit(default)
    for pattern, level in reversed([r for r in rules if r[0]]):
        shape = access.glob_pattern(pattern)
        claim = F.when(path.rlike(shape) | F.concat(F.lit("/"), path).rlike(shape), level).otherwise(claim)
    return claim
