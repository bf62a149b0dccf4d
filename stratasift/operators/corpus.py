"""Corpus lifecycle: snapshots, change sets, carry-forward, validation and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratasift.functions import rules


def snapshot_diff(current: DataFrame, stored: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change): NEW, MODIFIED, UNCHANGED or DELETED.

    A stored row that is archived counts as absent: its source is NEW when it
    comes back, and is not DELETED again.
    """
    c = current.select(key, *[F.col(x).alias(f"c_{x}") for x in compared], F.lit(True).alias("in_current"))
    s = stored.where(F.col("status") == "active").select(
        key, *[F.col(x).alias(f"s_{x}") for x in compared], F.lit(True).alias("in_stored")
    )
    same = F.lit(True)
    for x in compared:
        same = same & F.col(f"c_{x}").eqNullSafe(F.col(f"s_{x}"))
    return c.join(s, key, "full_outer").select(
        key,
        F.when(F.col("in_stored").isNull(), "NEW")
        .when(F.col("in_current").isNull(), "DELETED")
        .when(same, "UNCHANGED")
        .otherwise("MODIFIED")
        .alias("change"),
    )


class VersionMismatchError(RuntimeError):
    """Vectors of an old epoch that the new one's model didn't make."""


def carry_forward(
    old: DataFrame, unchanged: DataFrame, key: str, epoch_col: str, epoch: str, version_col: str | None = None, allowed: list[str] | None = None
) -> DataFrame:
    """Rows of an old epoch whose documents did not change, under the new epoch.

    With ``allowed``, a row of another version stops the build before anything is written.
    """
    kept = old.join(unchanged.select(key), key, "left_semi")
    if allowed is not None:
        known = F.coalesce(F.col(version_col).isin(*allowed), F.lit(False))
        others = [r[0] for r in kept.where(~known).select(version_col).distinct().limit(10).collect()]
        if others:
            raise VersionMismatchError(f"vectors of versions {others}; only {allowed} may be carried")
    return kept.withColumn(epoch_col, F.lit(epoch))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and stored ones that none of them replaces."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def missing_and_unexpected(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    a, b = expected.select(key).distinct(), present.select(key).distinct()
    return (
        a.join(b, key, "left_anti")
        .withColumn("problem", F.lit("missing"))
        .unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unexpected")))
    )


#: Hex digits of a digest by which it is folded with others, level by level.
DIGEST_LEVELS = (6, 4, 2, 0)


def ordered_digest(df: DataFrame, row: Column, by: list[str] | None = None) -> DataFrame:
    """(``by``, ``digest``, ``n_rows``): digest of rows whatever their order, one for each value of ``by``.

    Rows are digested where they are.  Digests are folded in order within the
    groups of their first six hex digits, the groups' digests in order within
    the first four, and so on, so that a group has 256 members at most but for
    the first level, which has a 16-millionth of the rows.
    """
    by = by or []
    folded = df.select(*by, F.sha2(row, 256).alias("h")).select(*by, F.col("h").alias("prefix"), "h", F.lit(1).cast("long").alias("n"))
    for digits in DIGEST_LEVELS:
        parts = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "h"))), lambda x: x["h"])
        group = F.substring("prefix", 1, digits) if digits else F.lit("")
        folded = folded.groupBy(*by, group.alias("group")).agg(F.sha2(F.array_join(parts, ""), 256).alias("h"), F.sum("n").alias("n"))
        folded = folded.withColumnRenamed("group", "prefix")
    found = folded.select(*by, F.col("h").alias("digest"), F.col("n").alias("n_rows"))
    if by:
        return found
    # A table without rows has the digest of nothing.
    nothing = F.sha2(F.lit(""), 256)
    return found.agg(F.coalesce(F.max("digest"), nothing).alias("digest"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"))


def ordered_digest_sql(name: str, rows: str, by: str = "") -> str:
    """The same as SQL: CTEs that end in ``name`` (by, d, n) over a relation ``rows`` (by, h)."""
    b, part = (f"{by}, ", f"{by}, ") if by else ("", "")
    out, last, value = [], rows, "h"
    for digits in DIGEST_LEVELS:
        this = f"{name}{digits}" if digits else name
        key = "h" if value == "h" else "g"
        count = "count(*)" if value == "h" else "sum(n)"
        out.append(
            f"{this} AS (SELECT {b}substr({key}, 1, {digits}) AS g, sha256(string_agg({value}, '' ORDER BY {key})) AS d, CAST({count} AS BIGINT) AS n FROM {last} GROUP BY {part}substr({key}, 1, {digits}))"
        )
        last, value = this, "d"
    return ", ".join(out)


def latest_decision(decisions: DataFrame, key: str, order: str) -> DataFrame:
    """The last decision per source, with its revision number."""
    w = Window.partitionBy(key).orderBy(order)
    last = Window.partitionBy(key)
    return (
        decisions.withColumn("revision", F.row_number().over(w))
        .withColumn("revisions", F.count(F.lit(1)).over(last))
        .where("revision = revisions")
        .drop("revisions")
    )


def resolve_trust(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """Trust class of each source; a decision counts only for the content it was made on."""
    joined = sources.join(ledger, ["source_id", "content_hash"], "left")
    approval = F.coalesce(
        "decided", F.when(F.col("trust") == "MANAGED_INTERNAL", "NOT_REQUIRED").otherwise("PENDING_REVIEW")
    )
    return joined.withColumn("approval", approval).withColumn(
        "trust_class", rules.trust_class(F.col("trust"), F.col("approval"))
    )
