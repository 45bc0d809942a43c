"""Positions and running sums over one order of all rows, without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.storage import shared_dir


def before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` and for each of `sums` a column: the sum of its long over all rows that come
    before in the order (0 for the first; `F.lit(1)` gives positions from 0).

    Rows are dealt out by ranges of the order, which must be total (no ties, or it does not
    matter which of them is first), and written with the number of their range. A range
    is summed up where it lies; what the ranges before it sum up to is one row a range,
    added up in the driver. No rows give no rows. Nulls go where `order` puts them.
    """
    spark, part = df.sparkSession, "__part"
    path = shared_dir(spark)
    named = df.withColumns({f"__{n}": c.cast("long") for n, c in sums.items()})
    ranged = named.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    each = rows.groupBy(part).agg(*[F.sum(f"__{n}").alias(n) for n in sums]).orderBy(part).collect()
    at, offsets = dict.fromkeys(sums, 0), []
    for r in each:
        offsets.append((r[part], *[at[n] for n in sums]))
        at = {n: at[n] + (r[n] or 0) for n in sums}
    table = spark.createDataFrame(offsets, ", ".join([f"{part} int", *[f"`__at_{n}` long" for n in sums]]))
    earlier = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = {n: F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0).cast("long")) + F.col(f"__at_{n}") for n in sums}
    return rows.join(F.broadcast(table), part).select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in running.items()])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` and a column `name`: a row's place, from 1, in the order.

    Rows are dealt out by ranges of the order, sorted in each and written with their place
    in the range; what the ranges before it hold, one number a range, is added up in the
    driver. One shuffle, no window, no task with all rows. Ties have different places.
    The written table is read again, so places do not change when a task is run again.
    """
    spark, path, at = df.sparkSession, shared_dir(df.sparkSession), F.col("__at")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    part = F.shiftright(at, 33).cast("int")  # the task's number stands in the upper bits
    each = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    offsets, seen = [], 0
    for r in each:
        offsets.append((r["part"], seen))
        seen += r["n"]
    table = spark.createDataFrame(offsets, "__part int, __seen long")
    place = F.col("__seen") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(table), part == F.col("__part")).select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))
