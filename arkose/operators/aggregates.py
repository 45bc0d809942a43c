"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arkose.operators.quantiles import exact_quantiles
from arkose.registry import Registry, as_sum, mean, money

R = Registry()


@R.query("SELECT sum(cast(o_totalprice as decimal(18,2)))::DOUBLE AS total, sum(cast(o_totalprice as decimal(18,2)))::DOUBLE / count(o_totalprice) AS mean, min(o_totalprice) AS least, max(o_orderdate) AS latest, count(*) AS n FROM orders")
def d1_global(t):
    return t.orders.agg(as_sum(money("o_totalprice")).alias("total"), mean(money("o_totalprice")).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_orderdate").alias("latest"), F.count("*").alias("n"))


@R.query("SELECT o_orderpriority, o_orderstatus, sum(cast(o_totalprice as decimal(18,2)))::DOUBLE AS total, min(o_orderdate) AS first, max(o_custkey) AS most, count(*) AS n FROM orders GROUP BY ALL")
def d1_grouped(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(as_sum(money("o_totalprice")).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_custkey").alias("most"), F.count("*").alias("n"))


@R.query("SELECT c_mktsegment, max(c_name) AS last_name, list_sort(list(DISTINCT c_nationkey)) AS nations FROM customer GROUP BY c_mktsegment")
def d2_sort_and_object_aggregate(t):
    """max of a string plans as a sort aggregate, collecting as an object-hash one."""
    return t.customer.groupBy("c_mktsegment").agg(F.max("c_name").alias("last_name"), F.array_sort(F.collect_set("c_nationkey")).alias("nations"))


@R.query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
def d3_count_distinct(t):
    return t.orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@R.query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, sum(cast(value as decimal(18,2))) FILTER (event_type = 'purchase')::DOUBLE AS spent FROM events GROUP BY user_id")
def d4_filtered(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), as_sum(F.when(F.col("event_type") == "purchase", money("value"))).alias("spent"))


@R.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def d5_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@R.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def d6_rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@R.query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g, grouping_id(l_returnflag, l_linestatus)::BIGINT AS id, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def d6_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.grouping_id("l_returnflag", "l_linestatus").cast("bigint").alias("id"), F.count("*").alias("n"))


@R.query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def d6_grouping_sets(t):
    return t.customer.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@R.query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def d7_pivot(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@R.query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR name IN (size, price))")
def d7_unpivot(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "name", "value")


@R.query("""SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS var, round(stddev_pop(value), 6) AS sdp, round(corr(value, user_id), 6) AS corr,
  round(covar_samp(value, user_id), 4) AS cov, round(covar_pop(value, user_id), 4) AS covp, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 6) AS icept, round(regr_r2(value, user_id), 9) AS r2, regr_count(value, user_id)::BIGINT AS n FROM events GROUP BY event_type""")
def d8_statistics(t):
    v, u = F.col("value"), F.col("user_id")
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.var_samp(v), 4).alias("var"), F.round(F.stddev_pop(v), 6).alias("sdp"), F.round(F.corr(v, u), 6).alias("corr"), F.round(F.covar_samp(v, u), 4).alias("cov"), F.round(F.covar_pop(v, u), 4).alias("covp"), F.round(F.regr_slope(v, u), 8).alias("slope"), F.round(F.regr_intercept(v, u), 6).alias("icept"), F.round(F.regr_r2(v, u), 9).alias("r2"), F.regr_count(v, u).alias("n"))


@R.query("""SELECT event_type, round(regr_avgx(value, user_id), 6) AS ax, round(regr_avgy(value, user_id), 6) AS ay, round(regr_sxx(value, user_id) / count(*), 3) AS sxx,
  round(regr_syy(value, user_id) / count(*), 3) AS syy, round(regr_sxy(value, user_id) / count(*), 3) AS sxy FROM events GROUP BY event_type""")
def d8_regression_sums(t):
    """Sums of squares and products, a row each, so rounding means the same at all sizes."""
    v, u, n = F.col("value"), F.col("user_id"), F.count("*")
    return t.events.groupBy("event_type").agg(
        F.round(F.regr_avgx(v, u), 6).alias("ax"),
        F.round(F.regr_avgy(v, u), 6).alias("ay"),
        F.round(F.regr_sxx(v, u) / n, 3).alias("sxx"),
        F.round(F.regr_syy(v, u) / n, 3).alias("syy"),
        F.round(F.regr_sxy(v, u) / n, 3).alias("sxy"),
    )


@R.query("SELECT event_type, round(kurtosis_pop(value), 6) AS kurt, round((avg(value^3) - 3*avg(value)*var_pop(value) - avg(value)^3) / stddev_pop(value)^3, 6) AS skew FROM events GROUP BY event_type")
def d9_moments(t):
    return t.events.groupBy("event_type").agg(F.round(F.kurtosis("value"), 6).alias("kurt"), F.round(F.skewness("value"), 6).alias("skew"))


@R.query("SELECT event_type, median(value) AS mid, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def d10_percentile(t):
    """Found by selection, so a group of any size has partial steps only."""
    found = exact_quantiles(t.events, ["event_type"], "value", {"mid": 0.5, "p90": 0.9})
    return found.withColumn("p90", F.round("p90", 6))


@R.query("SELECT event_type, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events GROUP BY event_type")
def d11_percentile_approx(t):
    return t.events.groupBy("event_type").agg(F.percentile_approx("value", 0.25, 1_000_000).alias("q1"), F.percentile_approx("value", 0.75, 1_000_000).alias("q3"))


@R.query("SELECT count(DISTINCT l_partkey) AS exact, true AS hll_near, true AS sketch_near, true AS theta_near FROM lineitem")
def d12_sketches(t):
    """Approximate counts, each asserted to be within a tenth of the exact one, which is 6
    standard errors or more of each. In one aggregate with the exact count there would be
    sketches for each value, so it is apart."""
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.1 * F.col("exact")
    exact = t.lineitem.agg(F.countDistinct("l_partkey").alias("exact"))
    a = t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("h"), F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("th"))
    return exact.crossJoin(a).select("exact", near("a").alias("hll_near"), near("h").alias("sketch_near"), near("th").alias("theta_near"))


@R.query("SELECT user_id, arg_max(event_id, ts) AS latest, arg_min(event_id, ts) AS earliest, arg_max(event_type, value) AS top_type FROM events GROUP BY user_id")
def d13_max_by(t):
    """Of rows with the same greatest or least value, the first by event_id. As in the SQL,
    rows with a null in either column are passed over."""
    known = lambda a, b, last: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(b, last))
    up, down = F.col("event_id"), F.bitwise_not("event_id")  # both without overflow
    latest = F.max_by("event_id", known("event_id", "ts", down))
    earliest = F.min_by("event_id", known("event_id", "ts", up))
    top = F.max_by("event_type", known("event_type", "value", down))
    return t.events.groupBy("user_id").agg(latest.alias("latest"), earliest.alias("earliest"), top.alias("top_type"))


@R.query("SELECT l_returnflag, c AS mode FROM (SELECT l_returnflag, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, c) = 1")
def d13_mode(t):
    """The least of the most frequent values, so ties have one result."""
    return t.lineitem.groupBy("l_returnflag").agg(F.mode("l_linenumber", True).alias("mode"))


@R.query("""SELECT l_orderkey, first(o_custkey) AS first_, last(o_orderdate) AS last_, any_value(o_orderstatus) AS any_, any_value(CASE WHEN l_linenumber > 1 THEN o_custkey END) AS later
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def d13_first_last(t):
    """Of columns with one value in a group, as the order of rows is not fixed."""
    later = F.when(F.col("l_linenumber") > 1, F.col("o_custkey"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.first("o_custkey").alias("first_"), F.last("o_orderdate").alias("last_"), F.any_value("o_orderstatus").alias("any_"), F.first(later, ignorenulls=True).alias("later"))


@R.query("SELECT user_id, string_agg(event_type, '>' ORDER BY event_id DESC) AS path FROM events GROUP BY user_id")
def d14_listagg(t):
    return t.events.groupBy("user_id").agg(F.expr("listagg(event_type, '>') WITHIN GROUP (ORDER BY event_id DESC)").alias("path"))


@R.query("SELECT user_id, list(event_id ORDER BY event_id) AS ids, list_sort(list(DISTINCT event_type)) AS kinds, string_agg(event_type, ',' ORDER BY event_id) AS path FROM events GROUP BY user_id")
def d14_collect(t):
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    out = t.events.groupBy("user_id").agg(pairs.alias("p"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return out.select("user_id", F.col("p.event_id").alias("ids"), "kinds", F.array_join("p.event_type", ",").alias("path"))


@R.query("SELECT user_id, bool_and(value > 1) AS every_, bool_or(value > 100) AS any_, bit_and(event_id) AS ba, bit_or(event_id) AS bo, bit_xor(event_id) AS bx FROM events GROUP BY user_id")
def d15_bool_bit(t):
    v, e = F.col("value"), "event_id"
    return t.events.groupBy("user_id").agg(F.bool_and(v > 1).alias("every_"), F.bool_or(v > 100).alias("any_"), F.bit_and(e).alias("ba"), F.bit_or(e).alias("bo"), F.bit_xor(e).alias("bx"))


@R.query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def d16_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@R.query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def d16_first_of_each(t):
    """Keeping the first row by key is an aggregate with a partial step, not a window."""
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))


@R.query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def d17_histogram(t):
    return t.events.groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@R.query("SELECT event_type, 8::BIGINT AS bins, true AS ordered, true AS whole, true AS near FROM events GROUP BY event_type")
def d17_histogram_numeric(t):
    """Eight bins by type, in order, that hold all rows, with the mean of all values."""
    by = t.events.groupBy("event_type").agg(F.histogram_numeric("value", F.lit(8)).alias("bins"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    total = lambda part: F.aggregate("bins", F.lit(0.0), lambda a, b: a + part(b).cast("double"))
    mean = total(lambda b: b["x"] * b["y"]) / F.col("n")
    x = F.transform("bins", lambda b: b["x"])
    return by.select("event_type", F.size("bins").cast("long").alias("bins"), (F.array_sort(x) == x).alias("ordered"), (total(lambda b: b["y"]) == F.col("n")).alias("whole"), (F.abs(mean - F.col("mean")) < 0.01 * F.abs(F.col("mean"))).alias("near"))
