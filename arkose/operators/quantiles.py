"""Exact quantiles of groups of any size, without a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.storage import forget, settled

#: Of a group's values so many at most are laid in order in one task.
FEW = 50_000
#: Cuts that a sketch of bounded size gives, and its accuracy.
CUTS, ACCURACY = 100, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], few: int = FEW) -> DataFrame:
    """Per group its keys and a column for each of `at`, a name and a share from 0 to 1: the
    value at the place share * (values - 1) in order, between two values in proportion.

    The value at a place is found by `_selected`; the next one, where it is needed, is the
    least above it, or the same while its run lasts: one more aggregate. All aggregates
    have partial steps.

    Nulls and NaN are no values; a group without values has null. A null key is a group
    of its own. Values are taken as doubles. An empty table gives no row.
    """
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]).alias("g"), F.when(~F.isnan(v), v).alias("v"))
    values = rows.where("v IS NOT NULL")
    shares = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(share)).alias("share")) for i, share in enumerate(at.values())])
    sizes = settled(rows.groupBy("g").agg(F.count("v").alias("n")))
    asked = sizes.where("n > 0").select("g", F.inline(shares), "n").withColumn("place", F.col("share") * (F.col("n") - 1))
    asked = settled(asked.select("g", "q", F.floor("place").alias("rank"), (F.col("place") - F.floor("place")).alias("rest")))
    each = values.select("g", F.explode(F.array(*map(F.lit, range(len(at))))).alias("q"), "v")
    low = settled(asked.join(_selected(each, asked.drop("rest"), few), ["g", "q"]))
    next_ = values.join(low, "g").groupBy("g", "q", "rank", "rest", "low").agg(F.count_if(F.col("v") <= F.col("low")).alias("upto"), F.min(F.when(F.col("v") > F.col("low"), F.col("v"))).alias("above"))
    high = F.when(F.col("upto") > F.col("rank") + 1, F.col("low")).otherwise(F.coalesce("above", "low"))
    between = F.when(high == F.col("low"), F.col("low")).otherwise((1 - F.col("rest")) * F.col("low") + F.col("rest") * high)
    wide = next_.groupBy("g").agg(*[F.max(F.when(F.col("q") == i, between)).alias(f"q{i}") for i in range(len(at))])
    out = sizes.join(wide, "g", "left")
    return out.select(*[F.col(f"g.k{i}").alias(c) for i, c in enumerate(keys)], *[F.col(f"q{i}").alias(name) for i, name in enumerate(at)])


def _selected(values: DataFrame, asked: DataFrame, few: int) -> DataFrame:
    """From values (g, q, v) and places (g, q, rank), from 0: (g, q, low), the values there.

    A selection in passes. A pass lays two cuts around each place, values that a sketch of
    bounded size gives, and counts the bins that they make: below, at the first, between,
    at the second, above. A place at a cut is done; else the bin that holds it, whichever
    it is, goes on, and no other value does. Each pass leaves out the cuts at least, so
    ties cannot hold it up; the sketch's error costs passes, never the result. When all
    bins have at most `few` values, they are laid in order.
    """
    by, done, written = ["g", "q"], [], []
    while True:
        sketch = values.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], ACCURACY).alias("cuts"))
        step = F.floor((F.col("rank") + 0.5) / F.col("n") * CUTS).cast("int")
        cut = lambda i: F.get("cuts", F.least(F.greatest(i, F.lit(0)), F.lit(CUTS)))
        now = settled(asked.join(sketch, by).select(*by, "rank", cut(step - 1).alias("lo"), cut(step + 2).alias("hi")))
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        counts = values.join(now, by).groupBy(*by, "rank", "lo", "hi").agg(F.count_if(v < lo).alias("c0"), F.count_if(v <= lo).alias("c1"), F.count_if(v < hi).alias("c2"), F.count_if(v <= hi).alias("c3"), F.count("*").alias("c4"))
        ends = [F.col(f"c{i}") for i in range(5)]
        bin_ = F.coalesce(*[F.when(F.col("rank") < ends[i], i) for i in range(4)], F.lit(4))
        counts = counts.withColumn("bin", bin_).withColumn("before", F.when(F.col("bin") == 0, 0).otherwise(F.get(F.array(*ends), F.col("bin") - 1)))
        left = settled(counts.select(*by, "lo", "hi", "bin", (F.col("rank") - F.col("before")).alias("left"), (F.get(F.array(*ends), F.col("bin")) - F.col("before")).alias("size")))
        sure = F.col("bin").isin(1, 3)
        done.append(left.where(sure).select(*by, F.when(F.col("bin") == 1, lo).otherwise(hi).alias("low")))
        most = left.where(~sure).agg(F.max("size")).first()[0]
        if most is not None:
            inside = F.when(F.col("bin") == 0, v < lo).when(F.col("bin") == 2, (v > lo) & (v < hi)).otherwise(v > hi)
            values = settled(values.join(left.where(~sure), by).where(inside).select(*by, "v"))
            written.append(values)
            asked = left.where(~sure).select(*by, F.col("left").alias("rank"))
        if most is None or most <= few:
            break
    if most is not None:
        order = Window.partitionBy(*by).orderBy("v")  # over at most `few` values
        placed = values.withColumn("at", F.row_number().over(order) - 1).join(asked, by).where("at = rank")
        done.append(placed.select(*by, F.col("v").alias("low")))
    out = settled(reduce(DataFrame.union, done))
    forget(*written)
    return out
