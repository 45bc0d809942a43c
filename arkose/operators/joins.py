"""Joins, and the ones that Spark has no operator for: as-of, interval, salted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.registry import Registry, as_sum, money
from arkose.storage import settled

R = Registry()
#: More keys than this cannot be hot; the bound keeps what is broadcast small.
MOST_HOT = 4096


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], ranges: str | None = None) -> DataFrame:
    """For each left row the `values` of the latest right row of the same key that is not
    later (null if there is none).

    One shuffle by key: both sides are laid in one order and the last right row is
    carried on, so neither side is paired with the other. Among right rows of one time
    the greatest by `values` counts. A left row whose key or time is null has no match; a
    right row of such a key or time is none. `by`, times and values must not clash.

    With `ranges` (a unit of date_trunc, as "day") a key's history is cut into ranges of
    time: each is ordered in a task of its own, and what a range ends with is carried over
    to the later ranges of the key, of which there is one row each. So a hot key, with
    its rows over many ranges, is not gathered.
    """
    carried = F.struct(*values)
    keyed = lambda time: " AND ".join(f"`{c}` IS NOT NULL" for c in [*by, time])
    kind = right.select(carried.alias("x")).schema["x"].dataType
    a = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1), "__v": F.lit(None).cast(kind)})
    none = a.where(f"NOT ({keyed(left_time)})")
    b = right.where(keyed(right_time)).select(*[F.col(c) for c in by], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), carried.alias("__v"))
    both = a.where(keyed(left_time)).unionByName(b, allowMissingColumns=True)
    cut = [] if ranges is None else ["__r"]
    if cut:
        both = both.withColumn("__r", F.date_trunc(ranges, "__t"))
    order = Window.partitionBy(*by, *cut).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order))
    if cut:
        ends = both.where("__side = 0").groupBy(*by, "__r").agg(F.max_by("__v", F.struct("__t", "__v")).alias("__end"))
        seen = both.select(*by, "__r").distinct().join(ends, [*by, "__r"], "left")
        earlier = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
        seen = seen.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
        both = both.where("__side = 1").join(seen, [*by, "__r"]).withColumn("__last", F.coalesce("__last", "__before"))
    columns = [F.col(f"`{c}`") for c in left.columns]
    found = both.where("__side = 1").select(*columns, *[F.col(f"__last.{v}").alias(v) for v in values])
    return found.union(none.select(*columns, *[F.col(f"__v.{v}").alias(v) for v in values]))


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int, extra: Column | None = None) -> DataFrame:
    """Pairs whose right time is in [left time, left time + seconds].

    Times fall into buckets as wide as the interval; a left row looks into two buckets, so
    the join is on equal buckets, not on all pairs. `extra` may add a condition.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("__b", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("__c", bucket(right_time))
    late = F.col(left_time) + F.make_dt_interval(secs=F.lit(seconds))
    on = (F.col("__b") == F.col("__c")) & F.col(right_time).between(F.col(left_time), late)
    return a.join(b, on if extra is None else on & extra).drop("__b", "__c")


def salted_join(large: DataFrame, other: DataFrame, key: str, salts: int, spread: Column, hot: DataFrame) -> DataFrame:
    """An inner join on `key` whose hot keys are spread over `salts` tasks: of the other
    side only the rows of hot keys are repeated, once for each salt. `hot` is a table of
    one column, the keys to spread."""
    marked = hot.select(F.col(hot.columns[0]).alias("__hot")).distinct()
    if marked.count() > MOST_HOT:
        raise ValueError(f"more than {MOST_HOT} keys cannot all be hot")
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    a = large.join(F.broadcast(marked), F.col(key) == F.col("__hot"), "left")
    a = a.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(salt)).drop("__hot")
    b = other.join(F.broadcast(marked), F.col(key) == F.col("__hot"), "left")
    b = b.withColumn("__salt", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("__hot")
    return a.join(b, [key, "__salt"]).drop("__salt")


def hot_keys(df: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """The keys of more than one row in `share`, so fewer than `share` of them: counted once,
    with a partial step, and written."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return settled(counts.where(F.col("__n") * share > df.count()).select(key))


def skew_join(large: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on `key` by sorting whose skewed partitions Spark cuts while it runs. It can cut
    only where each input comes straight from a shuffle of its own, so `other`, which may
    be an aggregate by the same key, is written before. Without statistics or salts: the
    sizes of the shuffled partitions decide."""
    return large.join(settled(other).hint("merge"), key, how)


_RICH = "(SELECT * FROM customer WHERE c_acctbal > 5000)"


def _kind(how, sql):
    def run(t):
        return t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), how).select("o_orderkey", "c_custkey", "c_name")

    run.__name__, run.__doc__ = f"c1_{how}_join", f"Orders and customers of high balance, {how}."
    R.query(f"SELECT o_orderkey, c_custkey, c_name FROM orders {sql} JOIN {_RICH} ON o_custkey = c_custkey")(run)


for _how, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _kind(_how, _sql)


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def c2_semi_join(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def c2_anti_join(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


def not_in(left: DataFrame, column: str, right: DataFrame) -> DataFrame:
    """Rows of `left` whose column is NOT IN the one column of `right`, as SQL has it: all,
    if `right` has no row; none, if it has a null; else those whose column is not null
    and not there. One small aggregate decides, so the rest is a plain anti join."""
    key = F.col(right.columns[0])
    rows, nulls = right.agg(F.count("*"), F.count_if(key.isNull())).first()
    if nulls:
        return left.limit(0)
    if not rows:
        return left
    return left.where(F.col(column).isNotNull()).join(right, F.col(column) == key, "left_anti")


@R.query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def c3_not_in(t):
    return not_in(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem.where("l_quantity > 25").select("l_orderkey"))


_HINTED = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def _hinted(name, hint):
    def run(t):
        return t.customer.join(t.nation.hint(hint), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))

    run.__name__, run.__doc__ = name, f"The join with the hint {hint} (nation has 25 rows)."
    R.query(_HINTED)(run)


for _name, _hint in (("c4_broadcast_join", "broadcast"), ("c5_sort_merge_join", "merge"), ("c6_shuffled_hash_join", "shuffle_hash"), ("c7_replicated_join", "shuffle_replicate_nl")):
    _hinted(_name, _hint)


@R.query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def c7_cross_join(t):
    """Every pair is what a cross join asks for; both tables are of fixed size."""
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@R.query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def c8_theta_join(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") != F.col("b.n_regionkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@R.query("SELECT r_regionkey, n_nationkey FROM region FULL JOIN nation ON r_regionkey > n_nationkey")
def c8_theta_full_join(t):
    return t.region.join(t.nation, F.col("r_regionkey") > F.col("n_nationkey"), "full").select("r_regionkey", "n_nationkey")


@R.query("SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'")
def c9_interval_join(t):
    e = t.events
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("viewed"))
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("w"), F.col("ts").alias("bought"))
    return interval_join(views, bought, "viewed", "bought", 7200, F.col("u") == F.col("w")).select("view_id", "purchase_id")


_ASOF = "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"


@R.query(_ASOF)
def c10_asof_join(t):
    e = t.events
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    return asof_join(buys, clicks, ["user_id"], "ts", "clicked", ["click_id"]).select("event_id", "click_id")


@R.query(_ASOF)
def c11_asof_by_ranges(t):
    """The same rows with each user's history cut into days."""
    e = t.events
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    return asof_join(buys, clicks, ["user_id"], "ts", "clicked", ["click_id"], ranges="day").select("event_id", "click_id")


_NULL_TIMES = "SELECT event_id, event_type, nullif(user_id % 5, 3) AS u, CASE WHEN event_id % 11 > 0 THEN ts END AS ts FROM events"


@R.query(f"""WITH n AS ({_NULL_TIMES}) SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM n WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT * FROM n WHERE event_type = 'click' AND ts IS NOT NULL) c ON p.u = c.u AND p.ts >= c.ts""")
def c10_asof_nulls(t):
    """Keys and times with nulls, on both sides; null keys and times match nothing."""
    n = t.sql(_NULL_TIMES.replace("FROM events", "FROM {events}"), "events")
    buys = n.where("event_type = 'purchase'").select("event_id", "u", "ts")
    clicks = n.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "u", F.col("ts").alias("clicked"))
    return asof_join(buys, clicks, ["u"], "ts", "clicked", ["click_id"], ranges="day").select("event_id", "click_id")


@R.query("SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")
def c12_lateral_join(t):
    inner = t.nation.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).select(F.count("*").alias("n"))
    return t.region.lateralJoin(inner).select("r_name", "n")


@R.query("""SELECT r_name, sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))))::DOUBLE AS revenue, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def c13_star_join(t):
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(as_sum(money("l_extendedprice") * (1 - money("l_discount"))).alias("revenue"), F.count("*").alias("n"))
    )


@R.query("SELECT a.c_custkey AS a, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_acctbal < b.c_acctbal GROUP BY a.c_custkey")
def c13_richer_in_group(t):
    """How many customers of a group have more: a count over an order, not all pairs."""
    above = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("c_nationkey", "c_mktsegment", "c_acctbal")
    rows = t.customer.where("c_nationkey is not null and c_mktsegment is not null and c_acctbal is not null")
    rows = rows.select(F.col("c_custkey").alias("a"), (F.count("*").over(above) - F.count("*").over(ties)).alias("n")).where("n > 0")
    return rows.groupBy("a").agg(F.sum("n").alias("n"))


@R.query("SELECT a.l_orderkey AS l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey")
def c13_self_join(t):
    """Lines of an order with a later line of it: an equi-join of a table with itself."""
    a, b = (t.lineitem.select("l_orderkey", "l_linenumber").alias(x) for x in "ab")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    return a.join(b, on).groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count("*").alias("n"))


@R.query("SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def c14_salted_join(t):
    orders = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber")
    return salted_join(lines, orders, "k", 8, F.struct("l_partkey", "l_linenumber"), hot_keys(lines, "k")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_SKEWED = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS k, l_orderkey, l_linenumber FROM lineitem"
_BY_BRAND = f"SELECT p_brand, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM ({_SKEWED}) JOIN (SELECT p_partkey AS k, p_brand FROM part) USING (k) GROUP BY p_brand"


def _skewed(t) -> tuple[DataFrame, DataFrame]:
    """Order lines, a third of them of one part, and the parts."""
    return t.sql(_SKEWED.replace("FROM lineitem", "FROM {lineitem}"), "lineitem"), t.part.select(F.col("p_partkey").alias("k"), "p_brand")


def _by_brand(joined: DataFrame) -> DataFrame:
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))


@R.query(_BY_BRAND)
def c14_skew_join(t):
    """A third of the rows has one key: adaptive execution splits its partition."""
    return _by_brand(skew_join(*_skewed(t), "k"))


@R.query(_BY_BRAND)
def c14_salted_skew(t):
    """The same rows with the hot key counted and spread over salts."""
    lines, parts = _skewed(t)
    return _by_brand(salted_join(lines, parts, "k", 16, F.struct("l_orderkey", "l_linenumber"), hot_keys(lines, "k", 100)))


@R.query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def c14_bucketed_join(t):
    """Both sides written in equal buckets: the join of the tables needs no exchange."""
    from arkose.sources.formats import bucketed

    a, b = bucketed(t.lineitem.select("l_orderkey"), "l_orderkey"), bucketed(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return a.join(b, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
