"""Streaming queries; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.streaming import events

from .catalog import register
from .fixtures import table


@register(
    "stream_tumbling_counts",
    "SELECT time_bucket(interval 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def stream_tumbling_counts(spark, sf):
    return events.run_to_table(events.tumbling_counts(events.event_stream(spark, sf)))


@register(
    "stream_sliding_avg",
    """SELECT time_bucket(interval 1 hour, ts) - i * interval 1 hour AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM events, unnest(range(0, 6)) u(i) GROUP BY 1""",
)
def stream_sliding_avg(spark, sf):
    return events.run_to_table(events.sliding_average(events.event_stream(spark, sf)))


@register(
    "stream_session_activity",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval 2 hour THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, sid""",
)
def stream_session_activity(spark, sf):
    return events.run_to_table(events.session_activity(events.event_stream(spark, sf)))


@register("stream_dedup", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    return events.run_to_table(events.deduplicated(events.event_stream(spark, sf)), "append")


@register(
    "stream_static_join",
    """SELECT event_id, user_id, event_type, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey""",
)
def stream_static_join(spark, sf):
    static = table(spark, sf, "nation").select("n_nationkey", "n_name")
    e = events.event_stream(spark, sf).select("event_id", "user_id", "event_type", (F.col("user_id") % 25).cast("int").alias("n_nationkey"))
    return events.run_to_table(e.join(F.broadcast(static), "n_nationkey").drop("n_nationkey"), "append")
