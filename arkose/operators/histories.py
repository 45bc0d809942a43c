"""Windows over one key's history, cut into ranges of time so that no task has all of it.

Each range is a window of its own. What a frame needs of earlier ranges is carried over:
one running total a range, the last rows before it, or the rows that its interval reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.operators.windows import top_k_per_group
from arkose.registry import Registry, money

R = Registry()
_BEFORE = (Window.unboundedPreceding, -1)


def _cut(df: DataFrame, time: str, unit: str) -> DataFrame:
    return df.withColumn("__r", F.date_trunc(unit, F.col(time)))


def running_sum(df: DataFrame, keys: list[str], time: str, value: Column, name: str, unit: str = "day") -> DataFrame:
    """`df` and `name`: the sum of `value` over the key's rows up to the row's time, ties
    included (SQL's default frame). A range adds what it has itself to the total of the
    ranges before it, of which there is one row each. A null key is a key; rows of a null
    time come first and tie. Sums of decimals do not depend on the order of the rows."""
    rows = _cut(df.withColumn("__v", value), time, unit)
    each = rows.groupBy(*keys, "__r").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(*_BEFORE)
    carried = each.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__r").alias("__of"), F.sum("__t").over(before).alias("__c"))
    on = F.col("__r").eqNullSafe(F.col("__of"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = F.sum("__v").over(Window.partitionBy(*keys, "__r").orderBy(time))
    total = F.when(inside.isNull() & F.col("__c").isNull(), None).otherwise(F.coalesce(inside, F.lit(0)) + F.coalesce("__c", F.lit(0)))
    return rows.join(carried, on).select(*[F.col(f"`{c}`") for c in df.columns], total.alias(name))


def last_rows(df: DataFrame, keys: list[str], order: list[str], made: dict[str, Column], rows_before: int, unit: str = "day") -> DataFrame:
    """`df` and for each of `made` an aggregate over the row and the `rows_before` rows of its
    key before it, in a total `order` whose first column is a time. Of each range its last
    rows are kept, and of the ranges just before a range they are laid before it; since a
    range has a row at least, `rows_before` ranges are enough."""
    rows = _cut(df, order[0], unit)
    packed = rows.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    kept = top_k_per_group(packed.select(*keys, "__r", *[o for o in order if o not in keys], "__row"), [*keys, "__r"], [F.col(o).desc_nulls_last() for o in order], rows_before)
    ends = kept.groupBy(*keys, "__r").agg(F.collect_list(F.struct(*order, "__row")).alias("__ends"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(-rows_before, -1)
    halo = ends.select(*keys, "__r", F.flatten(F.collect_list("__ends").over(before)).alias("__all"))
    halo = halo.select("__r", F.explode(F.slice(F.reverse(F.array_sort("__all")), 1, rows_before)).alias("__h")).select("__h.__row.*", "__r", F.lit(False).alias("__own"))
    both = rows.withColumn("__own", F.lit(True)).unionByName(halo)
    frame = Window.partitionBy(*keys, "__r").orderBy(*order).rowsBetween(-rows_before, 0)
    return both.withColumns({n: c.over(frame) for n, c in made.items()}).where("__own").drop("__own", "__r")


def interval_counts(df: DataFrame, keys: list[str], time: str, seconds: int, name: str) -> DataFrame:
    """`df` and `name`: how many rows of the key lie in the `seconds` up to the row's time, both
    ends and ties included. Ranges are as long as the interval, so a row counts in its own
    range and the next one; a null time is in no interval but that of null times."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.withColumns({"__m": micros, "__r": F.floor(micros / (seconds * 1_000_000))})
    own, next_ = F.struct(F.col("__r").alias("r"), F.lit(True).alias("own")), F.struct((F.col("__r") + 1).alias("r"), F.lit(False).alias("own"))
    copies = F.when(F.col("__r").isNull(), F.array(own)).otherwise(F.array(own, next_))
    both = rows.withColumn("__c", F.explode(copies)).withColumns({"__at": F.col("__c.r"), "__own": F.col("__c.own")})
    frame = Window.partitionBy(*keys, "__at").orderBy("__m").rangeBetween(-seconds * 1_000_000, 0)
    out = both.withColumn(name, F.count("*").over(frame)).where("__own")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)


_MONEY = "sum(cast(value as decimal(18,2)))"


@R.query(f"SELECT event_id, {_MONEY} OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS total FROM events")
def e5_running_in_ranges(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    return running_sum(rows, ["user_id"], "ts", money("value"), "total").select("event_id", F.col("total").cast("double").alias("total"))


@R.query(f"SELECT event_id, {_MONEY} OVER w::DOUBLE / count(*) OVER w AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def e6_rows_in_ranges(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    made = {"s": F.sum(money("value")), "n": F.count("*")}
    return last_rows(rows, ["user_id"], ["ts", "event_id"], made, 4).select("event_id", (F.col("s").cast("double") / F.col("n")).alias("moving"))


@R.query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def e7_interval_in_ranges(t):
    return interval_counts(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 86_400, "n").select("event_id", "n")
