"""Window functions and top-k by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.registry import Registry, money

R = Registry()


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark cuts groups to k rows before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def _by():
    return Window.partitionBy("user_id").orderBy("ts")


@R.query("SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), v AS (PARTITION BY user_id ORDER BY event_type)")
def e1_ranks(t):
    v = Window.partitionBy("user_id").orderBy("event_type")
    return t.events.select("event_id", F.row_number().over(_by()).cast("bigint").alias("rn"), F.rank().over(v).cast("bigint").alias("rk"), F.dense_rank().over(v).cast("bigint").alias("dr"))


@R.query("SELECT event_id, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, ntile(4) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def e2_distribution(t):
    return t.events.select("event_id", F.percent_rank().over(_by()).alias("pr"), F.cume_dist().over(_by()).alias("cd"), F.ntile(4).over(_by()).cast("bigint").alias("nt"))


@R.query("SELECT event_id, lead(value, 1, 0.0) OVER w AS nxt, lag(value) OVER w AS prv, lag(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS click FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def e3_lag_lead(t):
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return t.events.select("event_id", F.lead("value", 1, 0.0).over(_by()).alias("nxt"), F.lag("value").over(_by()).alias("prv"), F.last(click, ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, -1)).alias("click"))


@R.query("SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def e4_first_last(t):
    w = _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select("event_id", F.first("value").over(w).alias("f"), F.last("value").over(w).alias("l"), F.nth_value("value", 3).over(w).alias("n3"))


@R.query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_type) AS n, sum(cast(value as decimal(18,2))) OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS total FROM events")
def e5_running(t):
    """The default frame ends with the last row that ties with the current one."""
    ties = Window.partitionBy("user_id").orderBy("event_type")
    return t.events.select("event_id", F.count("*").over(ties).alias("n"), F.sum(money("value")).over(_by()).cast("double").alias("total"))


@R.query("SELECT event_id, sum(cast(value as decimal(18,2))) OVER w::DOUBLE / count(*) OVER w AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def e6_rows_frame(t):
    w = _by().rowsBetween(-4, 0)
    return t.events.select("event_id", (F.sum(money("value")).over(w).cast("double") / F.count("*").over(w)).alias("moving"))


_RANGE = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}"


@R.query(_RANGE.replace("{events}", "events"))
def e7_range_frame(t):
    return t.sql(_RANGE, "events")


@R.query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def e8_qualify(t):
    return top_k_per_group(t.events, ["user_id"], [F.desc("value"), F.asc("event_id")], 1).select("user_id", "event_id")


@R.query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def e9_top_k_per_group(t):
    return top_k_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")
