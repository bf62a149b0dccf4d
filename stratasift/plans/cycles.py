"""Queries over state that outlives a run: dialogue sessions in a stream, and the feedback cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.operators.feedback_cycle import FeedbackStore
from stratasift.staging import new_folder
from stratasift.streaming import dialogues, events

from .catalog import register
from .fixtures import table

_ROUNDS_SQL = """r AS (SELECT CASE WHEN user_id % 3 = 0 THEN '' ELSE 'o' || user_id % 5 END AS owner, 's' || user_id % 40 AS session, ts, event_id AS id,
  event_type || ':' || event_id AS round, CASE WHEN event_type = 'purchase' THEN 'd' || event_id % 100 END AS evidence FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < interval 2 hour THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY owner, session ORDER BY ts, id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY owner, session ORDER BY ts, id) AS nth FROM g)
SELECT owner, session, ts, id, first_value(ts) OVER w AS session_start, CAST(least(row_number() OVER w, 6) AS INT) AS n_rounds,
  array_to_string(list(round) OVER (PARTITION BY owner, session, nth ORDER BY ts, id ROWS 5 PRECEDING), '|') AS frame, first_value(evidence IGNORE NULLS) OVER w AS evidence
FROM n WINDOW w AS (PARTITION BY owner, session, nth ORDER BY ts, id)"""


def _rounds(rows):
    u, e = F.col("user_id"), F.col("event_id")
    return rows.select(
        F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("o"), (u % 5).cast("string"))).alias("owner"),
        F.concat(F.lit("s"), (u % 40).cast("string")).alias("session"),
        F.col("ts").cast("timestamp").alias("ts"),
        e.alias("id"),
        F.concat_ws(":", "event_type", e.cast("string")).alias("round"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("d"), (e % 100).cast("string"))).alias("evidence"),
    )


@register("dialogue_sessions", f"WITH {_ROUNDS_SQL}")
def dialogue_sessions(spark, sf):
    return dialogues.batch_sessions(_rounds(table(spark, sf, "events")))


@register("stream_dialogue_sessions", f"WITH {_ROUNDS_SQL}")
def stream_dialogue_sessions(spark, sf):
    """The same sessions out of keyed state with timers."""
    return events.run_to_table(dialogues.stream_sessions(_rounds(events.event_stream(spark, sf))), "append")


_LOG_SQL = """f AS (SELECT sha256('fb:' || event_id) AS feedback_id, event_id, ts, CAST(floor(value) AS BIGINT) % 3 - 1 AS rating, event_type = 'error' AS corrected, event_type <> 'view' AS answered FROM events),
cut AS (SELECT to_timestamp(floor((epoch(min(ts)) + epoch(max(ts))) / 2)) AT TIME ZONE 'UTC' AS mid FROM events)"""
_STATUS_SQL = "CASE WHEN event_id % 5 = 0 THEN 'rejected' WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'pending' END"


def _cycle(spark, sf):
    """A run over the first half of the log, one over all of it, and one that finds nothing new; decisions between them."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = rows.select(
        F.sha2(F.concat(F.lit("fb:"), F.col("event_id").cast("string")), 256).alias("feedback_id"),
        "ts",
        (F.floor("value") % 3 - 1).alias("rating"),
        (F.col("event_type") == "error").alias("corrected"),
        (F.col("event_type") != "view").alias("answered"),
        "event_id",
    )
    middle = rows.agg(F.timestamp_seconds(F.floor((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2_000_000)).alias("at"))
    early = log.crossJoin(F.broadcast(middle)).where("ts < at").drop("at")  # one row
    store = FeedbackStore(spark, new_folder(spark, "feedback"))
    wanted = ["feedback_id", "ts", "rating", "corrected", "answered"]
    store.collect(early.select(wanted))
    store.decide(early.where("event_id % 2 = 0").select("feedback_id", F.lit("accepted").alias("status")))
    store.collect(log.select(wanted))
    store.decide(log.where("event_id % 2 = 0").select("feedback_id", F.lit("accepted").alias("status")))
    store.decide(log.where("event_id % 5 = 0").select("feedback_id", F.lit("rejected").alias("status")))
    store.collect(log.select(wanted))
    return store


@register("feedback_cycle", f"WITH {_LOG_SQL} SELECT feedback_id, {_STATUS_SQL} AS status, CASE WHEN ts < mid THEN 1 ELSE 2 END AS run FROM f, cut")
def feedback_cycle(spark, sf):
    """Every record once, with the run that found it and the last decision."""
    return _cycle(spark, sf).statuses().select("feedback_id", "status", "run")


@register(
    "feedback_cycle_datasets",
    f"""WITH {_LOG_SQL}, a AS (SELECT *, {_STATUS_SQL} AS status FROM f) SELECT 'hard_negatives' AS dataset, feedback_id FROM a WHERE status = 'accepted' AND rating <= 0
    UNION ALL SELECT 'rewrite_corrections', feedback_id FROM a WHERE status = 'accepted' AND corrected UNION ALL SELECT 'evaluation', feedback_id FROM a WHERE status = 'accepted' AND answered
    UNION ALL SELECT 'preference', feedback_id FROM a WHERE status = 'accepted' AND corrected AND answered""",
)
def feedback_cycle_datasets(spark, sf):
    return _cycle(spark, sf).datasets()


@register(
    "feedback_cycle_runs",
    f"WITH {_LOG_SQL} SELECT 1 AS run, count_if(ts < mid) AS n_new FROM f, cut UNION ALL SELECT 2, count_if(ts >= mid) FROM f, cut UNION ALL SELECT 3, 0",
)
def feedback_cycle_runs(spark, sf):
    """A repeated run adds nothing."""
    return _cycle(spark, sf).runs().select("run", "n_new")
