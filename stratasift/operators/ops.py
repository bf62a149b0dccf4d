"""Analytics of request logs: sessions, rings, alerts, limits and caches."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .ranking import distributed_rank


def last_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The last ``n`` rows of each group, with their place from the end."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def sessions(df: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """Batch sessions: a gap of the given length or more ends one."""
    return df.groupBy(by, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def sustained(df: DataFrame, by: list[str], ts: str, violated: Column, seconds: int) -> DataFrame:
    """Runs of consecutive violations that last at least ``seconds``; recovery ends a run."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("bad", F.coalesce(violated, F.lit(False)))
    runs = flagged.withColumn("run", F.sum((~F.col("bad")).cast("int")).over(w)).where("bad")
    return (
        runs.groupBy(*by, "run")
        .agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count(F.lit(1)).alias("n"))
        .where(F.unix_seconds(F.col("until").cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) >= seconds)
        .drop("run")
    )


# Ends of an image path that are no failure.
HEALTHY = ("ok", "empty", "unset")


def path_metrics(df: DataFrame, outcome: str, detail: str, elapsed: str) -> DataFrame:
    """(outcome, detail, attempts, degraded, mean_ms): every attempt has one outcome, so the counts add up."""
    n = F.count(F.lit(1))
    return df.groupBy(outcome, detail).agg(
        n.alias("attempts"), F.count_if(~F.col(outcome).isin(*HEALTHY)).alias("degraded"), F.round(F.avg(elapsed), 6).alias("mean_ms")
    )


def flushed_batches(df: DataFrame, ts: str, tie: str, every: str, size: int) -> DataFrame:
    """(items, batches, mean_delay, utilisation) of micro-batches that close after a time or when they are full."""
    slot = df.withColumn("slot", F.window(ts, every)["start"])
    place = F.row_number().over(Window.partitionBy("slot").orderBy(ts, tie)) - 1
    batches = slot.withColumn("part", F.floor(place / size)).groupBy("slot", "part").agg(
        F.count(F.lit(1)).alias("items"),
        ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1_000_000).alias("delay"),
    )
    return batches.groupBy("items").agg(
        F.count(F.lit(1)).alias("batches"),
        F.round(F.avg("delay"), 6).alias("mean_delay"),
        F.round(F.avg(F.col("items") / float(size)), 6).alias("utilisation"),
    )


def cache_replay(df: DataFrame, key: list[str], ts: str, ttl: int) -> DataFrame:
    """Hits and misses of an access log under a time to live that every access starts anew."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(ts, "event_id"))
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return df.withColumn("hit", F.coalesce(age <= ttl * 1_000_000, F.lit(False)))


def ordered_fold(df: DataFrame, by: list[str], order: list[str], start: Callable, step: Callable, out: T.StructField, needs: list[str]) -> DataFrame:
    """Adds a column by folding each group's rows in order: ``step(state, *needs)`` gives its value, ``start()`` a group's state.

    A sequential rule has no other plan than one group after the other, but
    rows stream through: a task holds one batch and one state, whatever the
    size of its groups.
    """
    schema = T.StructType([*df.schema, out])

    def run(batches):
        last = state = None
        for batch in batches:
            keys = list(zip(*[batch[c] for c in by], strict=True))
            values = []
            for key, row in zip(keys, zip(*[batch[c] for c in needs], strict=True), strict=True):
                if key != last:
                    last, state = key, start()
                values.append(step(state, *row))
            yield batch.assign(**{out.name: values})

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


_ALLOWED = T.StructField("allowed", T.BooleanType())


def token_bucket(df: DataFrame, by: list[str], ts: str, rate_per_minute: int, idle: int = 300, tie: str = "event_id") -> DataFrame:
    """Adds ``allowed``: a bucket per key, whose capacity is twice the rate; idle keys start full."""
    capacity, per_second = 2.0 * rate_per_minute, rate_per_minute / 60.0

    def step(state, t):
        if "last" in state:
            gone = (t - state["last"]).total_seconds()
            state["level"] = capacity if gone > idle else min(capacity, state["level"] + gone * per_second)
        state["last"] = t
        ok = state["level"] >= 1
        state["level"] -= ok
        return ok

    return ordered_fold(df, by, [ts, tie], lambda: {"level": capacity}, step, _ALLOWED, [ts])


def sliding_limit(df: DataFrame, by: list[str], ts: str, limit: int, seconds: int, tie: str = "event_id") -> DataFrame:
    """Adds ``allowed``: at most ``limit`` accepted attempts in any window of ``seconds``."""

    def step(accepted, t):
        while accepted and (t - accepted[0]).total_seconds() >= seconds:
            accepted.popleft()
        ok = len(accepted) < limit
        if ok:
            accepted.append(t)
        return ok

    return ordered_fold(df, by, [ts, tie], deque, step, _ALLOWED, [ts])


def lru_replay(df: DataFrame, shard: Column, key: str, ts: str, size: int, ttl: int, tie: str = "event_id") -> DataFrame:
    """Hits of a least-recently-used cache per shard of keys, with a time to live."""

    def step(cache, k, t):
        stored = cache.get(k)
        ok = stored is not None and (t - stored).total_seconds() <= ttl
        if not ok:
            cache[k] = t
        cache.move_to_end(k)
        if len(cache) > size:
            cache.popitem(last=False)
        return ok

    hit = T.StructField("hit", T.BooleanType())
    return ordered_fold(df.withColumn("shard", shard), ["shard"], [ts, tie], OrderedDict, step, hit, [key, ts])


def two_level_cache(
    df: DataFrame, partition: list[str], key: str, ts: str, public: str, first: tuple[int, int], second_ttl: int, epoch: str, tie: str = "event_id"
) -> DataFrame:
    """Adds ``served``: ``L1``, ``L2`` or ``miss`` for each request of a node's log.

    The first level has ``first`` = (entries, seconds) for public requests only
    and is emptied when the epoch changes; the second is kept apart by
    permissions (part of the key) and epoch.  A miss fills both.
    """
    entries, first_ttl = first

    def step(state, k, t, is_public, e):
        near, far = state["near"], state["far"]
        if state.get("epoch") != e:
            near.clear()
            state["epoch"] = e
        if is_public and k in near:
            if (t - near[k]).total_seconds() < first_ttl:
                near.move_to_end(k)
                return "L1"
            del near[k]
        if (stored := far.get((k, e))) is not None and (t - stored).total_seconds() < second_ttl:
            return "L2"
        far[(k, e)] = t
        if is_public:
            near[k] = t
            if len(near) > entries:
                near.popitem(last=False)
        return "miss"

    served = T.StructField("served", T.StringType())
    return ordered_fold(df, partition, [ts, tie], lambda: {"near": OrderedDict(), "far": {}}, step, served, [key, ts, public, epoch])


#: Requests of a node that one task takes at once.
PRESSURE_BLOCK = 65_536


def running_pressure(df: DataFrame, order: list, cost: Column, budget: float, rows: int) -> DataFrame:
    """Share of the budget that the last ``rows`` requests of a node hold together.

    Nodes are few, so their requests are ranked without a node in one task and
    cut into blocks; the last requests of a block are given to the next one as
    well, which needs them for its first.
    """
    ranked = distributed_rank(df.withColumn("cost_", cost), ["node"], order, "place_")
    block = F.floor((F.col("place_") - 1) / PRESSURE_BLOCK)
    late = (F.col("place_") - 1) % PRESSURE_BLOCK >= PRESSURE_BLOCK - (rows - 1)
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = ranked.withColumn("lent_", F.explode(copies)).withColumn("block_", block + F.col("lent_"))
    w = Window.partitionBy("node", "block_").orderBy("place_").rowsBetween(-(rows - 1), 0)
    summed = spread.withColumn("pressure", F.round(F.sum("cost_").over(w) / budget, 6))
    return summed.where("lent_ = 0").select(*df.columns, "pressure")


def admission_fold(df: DataFrame, by: list[str], ts: str, budget: float, hold: int, tie: str = "event_id") -> DataFrame:
    """Adds ``reason``: admitted requests of a node hold budget for ``hold`` seconds.

    Rows need ``cost`` and ``priority``.
    """
    from stratasift.functions.rules import PRESSURE as P

    def decide(pressure: float, priority: str, fits: bool) -> tuple[bool, str]:
        if pressure > P["critical"] and priority != "P0":
            return False, "critical_p1_queued" if priority == "P1" else "critical_p2_rejected"
        if P["soft_stop"] < pressure <= P["critical"] and priority not in ("P0", "P1"):
            return False, "soft_stop"
        if not fits:
            return False, "critical_p0_budget" if pressure > P["critical"] else "budget_exceeded"
        if pressure > P["critical"]:
            return True, "critical"
        if pressure > P["soft_stop"]:
            return True, "downgrade" if priority == "P1" else "admitted"
        if pressure > P["truncate"]:
            return True, "admitted_with_truncation"
        return True, "admitted_with_tighten" if pressure > P["tighten"] else "admitted"

    def step(state, t, cost, priority):
        held = state["held"]
        while held and (t - held[0][0]).total_seconds() >= hold:
            state["used"] -= held.popleft()[1]
        if not held:
            state["used"] = 0.0
        ok, reason = decide(state["used"] / budget, priority, state["used"] + cost <= budget)
        if ok:
            held.append((t, cost))
            state["used"] += cost
        return reason

    reason = T.StructField("reason", T.StringType())
    return ordered_fold(df, by, [ts, tie], lambda: {"held": deque(), "used": 0.0}, step, reason, [ts, "cost", "priority"])
