"""Projections, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arkose.operators.ordered import before
from arkose.registry import Registry, as_sum, mean, money

R = Registry()

_PRICE = "cast(l_extendedprice as decimal(18,2))"


@R.query(f"""SELECT l_returnflag, l_linestatus, sum(cast(l_quantity as decimal(18,2)))::DOUBLE AS sum_qty, sum({_PRICE})::DOUBLE AS sum_base_price,
  sum({_PRICE} * (1 - cast(l_discount as decimal(18,2))))::DOUBLE AS sum_disc_price,
  sum({_PRICE} * (1 - cast(l_discount as decimal(18,2))) * (1 + cast(l_tax as decimal(18,2))))::DOUBLE AS sum_charge,
  sum(cast(l_quantity as decimal(18,2)))::DOUBLE / count(*) AS avg_qty, sum({_PRICE})::DOUBLE / count(*) AS avg_price, sum(cast(l_discount as decimal(18,2)))::DOUBLE / count(*) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""")
def pricing_summary(t):
    """The flagship: one pass over lineitem, partial sums before the shuffle."""
    price, discount, tax = money("l_extendedprice"), money("l_discount"), money("l_tax")
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            as_sum(money("l_quantity")).alias("sum_qty"),
            as_sum(price).alias("sum_base_price"),
            as_sum(price * (1 - discount)).alias("sum_disc_price"),
            as_sum(price * (1 - discount) * (1 + tax)).alias("sum_charge"),
            mean(money("l_quantity")).alias("avg_qty"),
            mean(price).alias("avg_price"),
            mean(discount).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


@R.query("SELECT o_orderkey AS order_key, o_totalprice * 1.1 AS with_fee, upper(o_orderpriority) AS priority, o_orderdate FROM orders")
def b1_project(t):
    return t.orders.withColumns({"with_fee": F.col("o_totalprice") * 1.1, "priority": F.upper("o_orderpriority")}).withColumnRenamed("o_orderkey", "order_key").select("order_key", "with_fee", "priority", "o_orderdate", "o_custkey").drop("o_custkey")


@R.query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '1996-01-01'")
def b2_filter(t):
    return t.orders.where(((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 100000)) & ~(F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@R.query("SELECT p_partkey, p_name LIKE '%a%e%' AS l, p_name ILIKE 'S%' AS i, regexp_matches(p_name, '[aeiou]{2}') AS r FROM part")
def b3_like(t):
    return t.part.select("p_partkey", F.col("p_name").like("%a%e%").alias("l"), F.col("p_name").ilike("S%").alias("i"), F.col("p_name").rlike("[aeiou]{2}").alias("r"))


@R.query("SELECT p_partkey, p_size IN (1, 5, 9) AS one_of, p_retailprice BETWEEN 900 AND 1000 AS within, nullif(p_size, 5) IS NULL AS five, nullif(p_size, 5) IS NOT DISTINCT FROM nullif(p_size, 9) AS same FROM part")
def b4_in_between_null(t):
    five, nine = F.nullif("p_size", F.lit(5)), F.nullif("p_size", F.lit(9))
    return t.part.select("p_partkey", F.col("p_size").isin(1, 5, 9).alias("one_of"), F.col("p_retailprice").between(900, 1000).alias("within"), five.isNull().alias("five"), five.eqNullSafe(nine).alias("same"))


@R.query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'P'), '-') AS status FROM orders")
def b5_case(t):
    size = F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "medium").otherwise("small")
    return t.orders.select("o_orderkey", size.alias("size"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("-")).alias("status"))


@R.query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, try_cast(event_type AS INTEGER) AS none, cast(floor(value) AS BIGINT) AS whole, cast(user_id AS VARCHAR) AS user_text FROM events")
def b6_cast(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("int").alias("none"), F.floor("value").cast("bigint").alias("whole"), F.col("user_id").cast("string").alias("user_text"))


_SUBQUERY = """SELECT c.c_custkey, c.c_acctbal FROM {customer} c
  WHERE c.c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3)
  AND EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100)
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM {customer} c2 WHERE c2.c_mktsegment = c.c_mktsegment)"""


@R.query(_SUBQUERY.replace("{", "").replace("}", ""))
def b7_subqueries(t):
    return t.sql(_SUBQUERY, "customer", "nation", "orders")


@R.query("SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def b7_exists_api(t):
    line = t.lineitem.where("l_quantity > 45").alias("l")
    return t.orders.alias("o").where(line.where(F.col("l.l_orderkey") == F.col("o.o_orderkey").outer()).exists()).select("o_orderkey")


@R.query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def b7_scalar_api(t):
    """A scalar subquery of the DataFrame API."""
    return t.customer.where(F.col("c_acctbal") > t.customer.agg(F.avg("c_acctbal")).scalar()).select("c_custkey")


@R.query("SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) AS status FROM orders")
def b1_select_expr(t):
    return t.orders.selectExpr("o_orderkey", "o_totalprice * 2 AS twice", "upper(o_orderstatus) AS status")


@R.query("SELECT o_orderstatus, true AS plain, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN true END AS strata, true AS known FROM orders GROUP BY o_orderstatus")
def b8_sample_shares(t):
    """Of each status, whether the samples' shares are within five deviations of what was asked
    for, and whether each sampled row is one of the table, once."""
    o = t.orders.select("o_orderkey", "o_orderstatus")
    plain, strata = (x.groupBy("o_orderstatus").agg(F.count("*").alias(n), F.countDistinct("o_orderkey").alias(f"{n}_keys")) for n, x in (("p", o.sample(0.1, seed=7)), ("s", o.sampleBy("o_orderstatus", {"F": 0.5, "O": 0.1}, seed=7))))
    rows = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(plain, "o_orderstatus", "left").join(strata, "o_orderstatus", "left")
    near = lambda c, share: F.abs(c - F.col("n") * share) <= 5 * F.sqrt(F.col("n") * share * (1 - share))
    by = F.when(F.col("o_orderstatus") == "F", near(F.col("s"), 0.5)).when(F.col("o_orderstatus") == "O", near(F.col("s"), 0.1))
    known = (F.col("p") == F.col("p_keys")) & (F.coalesce("s", F.lit(0)) == F.coalesce("s_keys", F.lit(0)))
    return rows.select("o_orderstatus", near(F.col("p"), 0.1).alias("plain"), by.alias("strata"), known.alias("known"))


@R.query()
def b8_sample(t):
    """Sampling is the feature: a tenth of the orders by a seed, and by status."""
    o = t.orders
    return o.sample(0.1, seed=7).select("o_orderkey", F.lit("plain").alias("how")).union(o.sampleBy("o_orderstatus", {"F": 0.5, "O": 0.1}, seed=7).select("o_orderkey", F.lit("by status")))


@R.query("SELECT *, row_number() OVER (ORDER BY k NULLS LAST, e) AS place FROM (SELECT event_id AS e, nullif(user_id % 7, 3) AS k FROM events)")
def f1_sort_nulls(t):
    """Places in a global order, counted over ranges of it rather than in one task."""
    rows = t.events.select(F.col("event_id").alias("e"), F.nullif(F.col("user_id") % 7, F.lit(3)).alias("k"))
    order = [F.col("k").asc_nulls_last(), F.col("e").asc()]
    rows = before(rows, order, {"place": F.lit(1)})
    return rows.withColumn("place", F.col("place") + 1).orderBy(*order)


@R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def f2_limit_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10)


@R.query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def f3_top_k(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@R.query("SELECT o_orderkey, o_orderdate FROM orders")
def f4_range_partitioned(t):
    return t.orders.select("o_orderkey", "o_orderdate").repartitionByRange("o_orderdate").sortWithinPartitions("o_orderdate", "o_orderkey")


@R.query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def g1_union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@R.query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def g1_union(t):
    return g1_union_all(t).distinct()


@R.query("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL BY NAME SELECT n_name AS name, n_regionkey AS region FROM nation")
def g1_union_by_name(t):
    return t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).unionByName(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), allowMissingColumns=True)


def _pair(t):
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


@R.query(f"{_C} INTERSECT {_S}")
def g2_intersect(t):
    a, b = _pair(t)
    return a.intersect(b)


@R.query(f"{_C} INTERSECT ALL {_S}")
def g2_intersect_all(t):
    a, b = _pair(t)
    return a.intersectAll(b)


@R.query("SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def g3_except(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.events.select("user_id"))


@R.query(f"{_C} EXCEPT ALL {_S}")
def g3_except_all(t):
    a, b = _pair(t)
    return a.exceptAll(b)


_RECURSIVE = """WITH RECURSIVE steps(k, n) AS (SELECT 1, 1 UNION ALL SELECT k * 2, n + 1 FROM steps WHERE n < 12)
SELECT s.n, s.k, r.r_name FROM steps s JOIN {region} r ON r.r_regionkey = s.k % 5"""


@R.query(_RECURSIVE.replace("{region}", "region"))
def g4_recursive(t):
    return t.sql(_RECURSIVE, "region")


@R.query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def g5_pipe_syntax(t):
    return t.sql("FROM {orders} |> WHERE o_totalprice > 1000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", "orders")
