"""Conventional relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import register
from .fixtures import table


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .where("l_shipdate <= timestamp '1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@register(
    "revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def revenue_by_nation(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    # Lines are summed per order before they meet the customers.
    per_order = li.groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    # A nation table has as many rows as there are nations.
    n = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    return (
        per_order.join(o, "l_orderkey").join(c, "c_custkey").join(n, "n_nationkey").groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))
    )


@register(
    "top_customers",
    """SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL ORDER BY total DESC, c_custkey LIMIT 20""",
)
def top_customers(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").orderBy(F.desc("total"), "c_custkey").limit(20).select("c_custkey", "c_name", "total")


@register(
    "rollup_region_nation",
    """SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def rollup_region_nation(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register(
    "cube_segment_status",
    """SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)""",
)
def cube_segment_status(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.cube("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(
    "semi_anti_orders",
    """SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL
    SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
)
def semi_anti_orders(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))

    def n(kind, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    return n("with", c.join(o, "c_custkey", "left_semi")).unionByName(n("without", c.join(o, "c_custkey", "left_anti")))


@register(
    "running_totals",
    """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders""",
)
def running_totals(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.row_number().over(w).cast("long").alias("nth"),
    )


@register(
    "asof_last_order",
    """WITH l AS (SELECT l_orderkey, l_linenumber, o_custkey AS custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey AS last_order FROM l ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o
      ON l.custkey = o.o_custkey AND l.l_shipdate >= o.o_orderdate""",
)
def asof_last_order(spark, sf):
    """The customer's latest order at the time a line was shipped: one union, one window, no range join."""
    o = table(spark, sf, "orders")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    left = line.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        "o_custkey", F.col("l_shipdate").alias("t"), F.lit(1).alias("kind"), "l_orderkey", "l_linenumber", F.lit(None).cast("long").alias("order")
    )
    right = o.select(
        "o_custkey", F.col("o_orderdate").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("l_orderkey"),
        F.lit(None).cast("int").alias("l_linenumber"), F.col("o_orderkey").alias("order"),
    )
    w = Window.partitionBy("o_custkey").orderBy("t", "kind", "order").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("last_order", F.last("order", ignorenulls=True).over(w))
    return both.where("kind = 1").select("l_orderkey", "l_linenumber", "last_order")


@register(
    "set_ops_parts",
    """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40) UNION ALL
    SELECT 'except', count(*) FROM (SELECT p_type FROM part WHERE p_size < 10 EXCEPT SELECT p_type FROM part WHERE p_size > 48) UNION ALL
    SELECT 'union', count(*) FROM (SELECT p_brand FROM part UNION SELECT p_type FROM part)""",
)
def set_ops_parts(spark, sf):
    p = table(spark, sf, "part")
    small = p.where("p_size < 10")

    def n(op, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")

    return (
        n("intersect", small.select("p_brand").intersect(p.where("p_size > 40").select("p_brand")))
        .unionByName(n("except", small.select("p_type").subtract(p.where("p_size > 48").select("p_type"))))
        .unionByName(n("union", p.select("p_brand").union(p.select("p_type")).distinct()))
    )


@register(
    "interval_join_events",
    """SELECT s.event_id AS signup_id, count(v.event_id) AS n_views FROM (SELECT * FROM events WHERE event_type = 'signup') s
      LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON s.user_id = v.user_id AND v.ts >= s.ts AND v.ts < s.ts + interval 6 hour GROUP BY s.event_id""",
)
def interval_join_events(spark, sf):
    """An equi-join on user and six-hour bucket, so that only neighbours in time meet."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    hours = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600)
    s = e.where("event_type = 'signup'").select("event_id", "user_id", "ts", F.explode(F.array(hours, hours + 1)).alias("b"))
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("v_id"), "user_id", F.col("ts").alias("v_ts"), hours.alias("b"))
    hit = s.join(v, ["user_id", "b"]).where("v_ts >= ts and v_ts < ts + interval 6 hours")
    n = hit.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return e.where("event_type = 'signup'").join(n, "event_id", "left").select(F.col("event_id").alias("signup_id"), F.coalesce("n", F.lit(0)).alias("n_views"))
