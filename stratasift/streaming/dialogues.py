"""Dialogue sessions as keyed state: two hours to live, owned by one principal, with a frame of rounds and a lock on evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: A session ends when nothing has come for so long; every round renews it.
TIME_TO_LIVE_S = 7200

#: Rounds that a session remembers.
FRAME = 6

OUTPUT = "owner string, session string, ts timestamp, id long, session_start timestamp, n_rounds int, frame string, evidence string"
STATE = "start timestamp, last timestamp, frame array<string>, evidence string"


def with_session_key(rounds: DataFrame) -> DataFrame:
    """Adds ``owner_key``: a session of one owner is not that of another who presents the same name; no owner is one of its own."""
    owner = F.when(F.col("owner").isNull() | (F.col("owner") == ""), F.lit("-")).otherwise(F.concat(F.lit("="), "owner"))
    return rounds.withColumn("owner_key", owner)


def _fold(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes a session's new rounds in their order; an expired one is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(pieces)).sort_values(["ts", "id"], kind="stable")
    start = last = evidence = None
    frame: list[str] = []
    if state.exists:
        start, last, frame, evidence = state.get
        start, last, frame = pd.Timestamp(start), pd.Timestamp(last), list(frame)
    out = []
    for r in rows.itertuples(index=False):
        if last is None or (r.ts - last).total_seconds() >= TIME_TO_LIVE_S:
            start, frame, evidence = r.ts, [], None
        last = r.ts
        frame = [*frame, r.round][-FRAME:]
        # The first evidence is locked until the session ends.
        evidence = evidence if evidence is not None else r.evidence
        out.append((r.owner, r.session, r.ts, r.id, start, len(frame), "|".join(frame), evidence))
    state.update((start.to_pydatetime(), last.to_pydatetime(), frame, evidence))
    ends = int(last.timestamp() * 1000) + TIME_TO_LIVE_S * 1000
    state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])


def stream_sessions(rounds: DataFrame, late: str = "2 hours") -> DataFrame:
    """(owner, session, ts, id, session_start, n_rounds, frame, evidence) of every round of a stream.

    ``rounds`` has owner, session, ts, id, round and evidence (null for none).
    Rounds of one session have to come in order up to the order within a
    micro-batch; state goes when the watermark has passed the session's end.
    """
    marked = with_session_key(rounds).withWatermark("ts", late)
    return marked.groupBy("owner_key", "session").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch_sessions(rounds: DataFrame) -> DataFrame:
    """The same as a batch, with window functions."""
    by = Window.partitionBy("owner_key", "session")
    order = by.orderBy("ts", "id")
    gap = F.col("ts").cast("double") - F.lag("ts").over(order).cast("double")
    rows = with_session_key(rounds).withColumn("new", F.coalesce(gap >= TIME_TO_LIVE_S, F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(order))
    within = Window.partitionBy("owner_key", "session", "nth").orderBy("ts", "id")
    return rows.select(
        "owner", "session", "ts", "id",
        F.first("ts").over(within).alias("session_start"),
        F.least(F.row_number().over(within), F.lit(FRAME)).alias("n_rounds"),
        F.array_join(F.collect_list("round").over(within.rowsBetween(1 - FRAME, 0)), "|").alias("frame"),
        F.first("evidence", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("evidence"),
    )
