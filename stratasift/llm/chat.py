"""Cumulative-snapshot collapse of logged conversations, and their rendering.

Chat logs often hold a conversation once for every turn it had so far.  A hash
of each prefix of turns tells which conversations are the beginning of longer
ones; an anti-join keeps the maximal ones.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, read_table, require

#: How a turn is rendered; the two holes are the role and the text.
TURN_FORMAT = "<|im_start|>{}\n{}<|im_end|>\n"


def _hashed(place) -> dict:
    """Two 64-bit hashes of a turn at its place."""
    return {lane: F.xxhash64(F.lit(lane), place, "role", "text") for lane in ("a", "b")}


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, total, a, b): two 64-bit hashes of each conversation's first n turns.

    Each turn is hashed with its place, and the hashes of a prefix are combined
    by exclusive or, so that a running window rolls them on.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("n", F.row_number().over(order).cast("long")).withColumns(_hashed(F.col("n")))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id",
        "n",
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("total"),
        F.bit_xor("a").over(running).alias("a"),
        F.bit_xor("b").over(running).alias("b"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, role, text) of conversations that no longer one begins with.

    Of equal conversations the one with the smallest id stays; role and text
    are given for those without an id, whose only turn they are.
    """
    hashed = prefix_hashes(turns.where("conv_id is not null"))
    nobody = F.lit(None).cast("string")
    ended = hashed.where("n = total").select("n", "a", "b", "conv_id", nobody.alias("role"), nobody.alias("text"))
    lone = turns.where("conv_id is null").withColumn("n", F.lit(1).cast("long")).withColumns(_hashed(F.col("n")))
    # Equal conversations become one row, and so do equal beginnings, before they meet.
    whole = (
        ended.unionByName(lone.drop("turn"))
        .groupBy("n", "a", "b")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_copies"),
            F.max("role").alias("role"),
            F.max("text").alias("text"),
        )
    )
    begun = hashed.where("n < total").select("n", "a", "b").distinct()
    return whole.join(begun, ["n", "a", "b"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "n_copies", "role", "text"
    )


def collapse_and_render(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    turn_format: str = TURN_FORMAT,
) -> DataFrame:
    """One row per maximal conversation: ``conv_id``, ``n_turns``, ``n_copies``, ``rendered``.

    Turns are ordered by turn number, then role and text, so ties and repeated
    rows (turns like any other) have one order.  Null roles and texts count as
    empty and null turn numbers come first; a row with a null conversation id
    is a conversation of one turn.  A conversation that equals another or is
    the beginning of a longer one is dropped; ``n_copies`` counts the equal
    ones.  Only conversations that stay are rendered, whole and at any length:
    one conversation has to fit in a task, since it becomes one value.  An
    empty table gives an empty result.  Other columns are not looked at.
    """
    require(df, conv_col, turn_col, role_col, text_col)
    before, between, after = turn_format.split("{}")
    turns = df.select(
        F.col(quoted(conv_col)).alias("conv_id"),
        F.col(quoted(turn_col)).alias("turn"),
        F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"),
    )
    kept = maximal_conversations(turns)

    def turn(role, text):
        return F.concat(F.lit(before), role, F.lit(between), text, F.lit(after))

    lone = kept.where("conv_id is null").select("conv_id", "n_turns", "n_copies", turn(F.col("role"), F.col("text")).alias("rendered"))
    staying = turns.join(kept.where("conv_id is not null").select("conv_id", "n_turns", "n_copies"), "conv_id")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    in_order = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    rendered = (
        staying.withColumn("place", F.row_number().over(order))
        .groupBy("conv_id")
        .agg(
            F.first("n_turns").alias("n_turns"),
            F.first("n_copies").alias("n_copies"),
            F.array_join(F.transform(in_order, lambda t: turn(t["role"], t["text"])), "").alias("rendered"),
        )
    )
    return rendered.unionByName(lone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n,
    list({'r': coalesce(role, ''), 't': coalesce(text, '')}
         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, 1, [{'r': coalesce(role, ''), 't': coalesce(text, '')}] FROM conversations WHERE conv_id IS NULL),
g AS (SELECT min(conv_id) AS conv_id, n, turns, count(*) AS copies FROM c GROUP BY n, turns)
SELECT conv_id, n AS n_turns, copies AS n_copies,
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.n > g.n AND h.turns[1:g.n] = g.turns)
"""
