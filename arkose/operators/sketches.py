"""Sketches that are kept by day, merged, and asked; each answer is held against the exact one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkose.operators.windows import top_k_per_group
from arkose.registry import Registry
from arkose.storage import settled

R = Registry()


def sketches(df: DataFrame, keys: list[str], column: str, items: int = 1000) -> DataFrame:
    """Per group of `keys` the rows and four sketches of a column of longs: quantiles (KLL),
    distinct values (HLL and theta) and frequent items. A sketch's size has a bound
    whatever the rows. Nulls are no values."""
    c = F.col(column)
    top = F.expr(f"approx_top_k_accumulate(`{column}`, {items})")
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.kll_sketch_agg_bigint(c).alias("kll"), F.hll_sketch_agg(c).alias("hll"), F.theta_sketch_agg(c).alias("theta"), top.alias("top"))


def merged(kept: DataFrame, keys: list[str], items: int = 1000) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; the rows are not read again."""
    return kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.expr(f"approx_top_k_combine(top, {items})").alias("top"))


def count_min(df: DataFrame, keys: list[str], column: str, width: int = 4096, depth: int = 5) -> DataFrame:
    """Per group of `keys` a count-min sketch as rows: (keys, line, cell, n), `depth` lines of
    at most `width` cells. Sketches are merged by adding up `n`. Nulls are not counted."""
    cells = F.array(*[F.struct(F.lit(d).cast("byte").alias("line"), _cell(F.col(column), d, width).alias("cell")) for d in range(depth)])
    return df.where(F.col(column).isNotNull()).select(*keys, F.inline(cells)).groupBy(*keys, "line", "cell").agg(F.count("*").alias("n"))


def _cell(value: Column, line: int, width: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(line), value), F.lit(width)).cast("int")


def count_min_asked(sketch: DataFrame, values: DataFrame, column: str, width: int = 4096, depth: int = 5) -> DataFrame:
    """For each row of `values` also `estimate`: the count of its `column` by a sketch (line,
    cell, n), which is never too small. A table of depth * width rows is what is broadcast."""
    out = values
    for d in range(depth):
        line = sketch.where(F.col("line") == d).select(F.col("cell").alias(f"cell{d}"), F.col("n").alias(f"n{d}"))
        out = out.join(F.broadcast(line), _cell(F.col(column), d, width) == F.col(f"cell{d}"), "left")
    least = F.least(*[F.coalesce(f"n{d}", F.lit(0).cast("long")) for d in range(depth)])
    return out.select(*[F.col(f"`{c}`") for c in values.columns], least.alias("estimate"))


@R.query("SELECT true AS kll_near, true AS hll_near, true AS theta_near, true AS top_equal, count(*)::BIGINT AS n FROM lineitem")
def d12_merged_sketches(t):
    """Sketches of each ship day, written, merged over all days: the KLL median's true rank is
    within 2 % of the middle, distinct counts within a tenth, and the frequent line numbers,
    fewer than the items tracked, have their exact counts."""
    lines = t.lineitem.select(F.date_trunc("day", "l_shipdate").alias("day"), "l_partkey", F.col("l_linenumber").cast("long").alias("line"))
    part = merged(settled(sketches(lines, ["day"], "l_partkey")), [])
    number = merged(settled(sketches(lines, ["day"], "line")), [])
    median = part.select(F.kll_sketch_get_quantile_bigint("kll", F.lit(0.5)).alias("x")).scalar()
    top = number.select(F.map_from_entries(F.expr("approx_top_k_estimate(top, 100)")).alias("x")).scalar()
    parts = lines.agg(F.countDistinct("l_partkey").alias("x")).scalar()
    upto = lines.where(F.col("l_partkey") <= median).agg(F.count("*").alias("x")).scalar()
    same = lines.groupBy("line").agg(F.count("*").alias("c")).agg(F.bool_and(F.coalesce(F.element_at(top, F.col("line")) == F.col("c"), F.lit(False))).alias("x")).scalar()
    near = lambda c: F.abs(c / parts - 1) < 0.1
    rank = F.abs(upto / F.col("n") - 0.5) < 0.02
    return part.select(rank.alias("kll_near"), near(F.hll_sketch_estimate("hll")).alias("hll_near"), near(F.theta_sketch_estimate("theta")).alias("theta_near"), same.alias("top_equal"), "n")


@R.query("SELECT l_returnflag, true AS never_under, true AS near FROM lineitem GROUP BY l_returnflag")
def d12_count_min(t):
    """Counts of parts by a count-min sketch of each flag and day, merged over the days: never
    too small, and at least 99 of 100 over by e / width of the flag's rows at most."""
    lines = t.lineitem.select("l_returnflag", F.date_trunc("day", "l_shipdate").alias("day"), "l_partkey")
    kept = settled(count_min(lines, ["l_returnflag", "day"], "l_partkey"))
    sketch = settled(kept.groupBy("l_returnflag", "line", "cell").agg(F.sum("n").alias("n")))
    out = None
    for flag in ("A", "N", "R"):
        exact = lines.where(F.col("l_returnflag") == flag).groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("c"))
        asked = count_min_asked(sketch.where(F.col("l_returnflag") == flag), exact, "l_partkey")
        over = F.col("estimate") - F.col("c")
        part = asked.withColumn("over", over).groupBy("l_returnflag").agg(F.sum("c").alias("n"), F.min("over").alias("least"), F.expr("percentile_approx(over, 0.99)").alias("most"))
        part = part.select("l_returnflag", (F.col("least") >= 0).alias("never_under"), (F.col("most") <= F.ceil(F.col("n") * float(np.e) / 4096)).alias("near"))
        out = part if out is None else out.union(part)
    return out


def _count_min_cells(sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a count-min sketch as Spark writes it: the factors of its lines, and its cells."""
    depth, width = np.frombuffer(sketch, ">i4", 2, 12)
    factors = np.frombuffer(sketch, ">i8", depth, 20).astype(np.int64)
    return factors, np.frombuffer(sketch, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width)


def count_min_estimates(sketch: bytes, items: np.ndarray) -> np.ndarray:
    """Counts of longs by a sketch of Spark's `count_min_sketch`, by its hash."""
    factors, cells = _count_min_cells(sketch)
    with np.errstate(over="ignore"):
        h = factors[:, None] * items.astype(np.int64)[None, :]
        h = h + (h >> 32) & (1 << 31) - 1
    return cells[np.arange(len(factors))[:, None], h % cells.shape[1]].min(0)


@R.query("SELECT l_returnflag, true AS kll_near, true AS cms_near FROM lineitem GROUP BY l_returnflag")
def d12_quantile_and_frequency_sketches(t):
    """By flag: the KLL median's true rank is within 2 % of the middle, and a count-min sketch
    gives the ten most frequent parts at least their counts and at most 1 % of the rows more."""
    by = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint("l_partkey"), F.lit(0.5)).alias("median"), F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(7)).alias("cms"))
    by = settled(by)
    counts = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("c"))
    often = top_k_per_group(counts, ["l_returnflag"], [F.desc("c"), F.asc("l_partkey")], 10)
    often = often.groupBy("l_returnflag").agg(F.collect_list(F.struct("l_partkey", "c")).alias("often"))

    @F.arrow_udf("array<long>")
    def estimates(sketch: pa.Array, items: pa.Array) -> pa.Array:
        return pa.array([count_min_estimates(s, np.array(i)).tolist() for s, i in zip(sketch.to_pylist(), items.to_pylist())], pa.list_(pa.int64()))

    upto = counts.join(F.broadcast(by.select("l_returnflag", "median")), "l_returnflag").groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_partkey") <= F.col("median"), F.col("c"))).alias("upto"))
    rows = by.join(often, "l_returnflag").join(upto, "l_returnflag").withColumn("est", estimates("cms", F.col("often.l_partkey")))
    over = F.zip_with("est", "often.c", lambda e, c: (e >= c) & (e <= c + F.col("n") * 0.01))
    return rows.select("l_returnflag", (F.abs(F.col("upto") / F.col("n") - 0.5) < 0.02).alias("kll_near"), F.forall(over, lambda x: x).alias("cms_near"))
