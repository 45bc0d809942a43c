"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source; the sources' targets follow from weights and caps; each
document is then taken floor(rate) times, and once more with a probability of the
rate's fraction, decided by a hash of its id and a seed. Of a fixed number of seeds, each
source has the one whose draws come nearest its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import forget, settled
from arkose.operators.ordered import before

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Seeds that a source's draws are chosen from.
SEEDS = 16


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows (source, size): source, source_size, target, rate.

    By code point, null last, the sources weigh WEIGHTS in turn and share the total of
    all sizes; a target ends at MOST times its source's size, and what is over goes to
    the others by weight until none is above its end. In the order of (end / weight),
    the sources at their ends come first: one is if the level that the rest would have
    with it reaches its ratio. A source of size 0 has target 0 and rate 0; a null size
    counts as 0; no rows give no rows; other columns are ignored.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("source_size"))
    place = F.col("source").asc_nulls_last()
    per = before(per, [place], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("ratio", F.lit(float(MOST)) * F.col("source_size") / F.col("weight"))
    per = settled(before(per, [F.col("ratio").asc(), place], {"full": F.col("source_size"), "weighed": F.col("weight")}))
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0) - MOST * F.col("full")).cast("double") / (F.lit(weights or 0) - F.col("weighed")).cast("double")
    per = per.withColumn("level", level)
    at_end = F.col("ratio") <= F.col("level")
    shared = per.agg(F.max(F.when(~at_end, F.col("level")))).first()[0]
    target = F.when(at_end, (MOST * F.col("source_size")).cast("double")).otherwise(F.lit(shared).cast("double") * F.col("weight"))
    per = per.withColumn("target", target)
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"))


def chance(id_: Column, seed: str, turn: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed, turn and id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), turn.cast("string"), id_.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def drawn(id_: Column, seed: str, turn: Column) -> Column:
    """Whether an id is taken once more than floor(rate)."""
    return chance(id_, seed, turn) < F.col("rate") - F.floor("rate")


def planned(sizes: DataFrame, seed: str = "mix") -> DataFrame:
    """From rows (id, source, size): `source_targets` and each source's turn, the number of
    its seed. The first turn wins a tie. One aggregate with a partial step adds up the
    draws of all turns. The result is a written table, so its size is known: Spark
    broadcasts it only while small."""
    per = settled(source_targets(sizes))
    rows = sizes.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    more = [F.coalesce(F.sum(F.when(drawn(F.col("id"), seed, F.lit(k)), F.col("size"))), F.lit(0).cast("long")).alias(f"turn{k}") for k in range(SEEDS)]
    sums = rows.groupBy("source").agg(*more).withColumnRenamed("source", "of")
    both = per.join(sums, F.col("source").eqNullSafe(F.col("of")))
    gap = lambda k: F.abs((F.floor("rate") * F.col("source_size") + F.col(f"turn{k}")).cast("double") - F.col("target"))
    turn = F.array_min(F.array(*[F.struct(gap(k).alias("gap"), F.lit(k).alias("turn")) for k in range(SEEDS)]))["turn"]
    out = settled(both.select("source", "source_size", "target", "rate", turn.alias("turn")))
    forget(per)
    return out


def times(id_: Column, seed: str) -> Column:
    """How often a row is taken, next to its source's plan."""
    return (F.floor("rate") + drawn(id_, seed, F.col("turn")).cast("long")).cast("long")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The written table (id, source, size) of all rows: texts are read once for it."""
    return settled(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))


def taken(df: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of `df`: id, size, source_size, target and copies, how often it is taken.

    A null text has size 0; texts count whole. A null source is a source of its own; a
    null id is one more id. Repeated rows (equal ids) are taken alike. A source of size 0
    has target 0 and is not taken. An empty table gives no row. Other columns are
    ignored.
    """
    sizes = sized(df, id_col, text_col, source_col)
    per = planned(sizes, seed).withColumnRenamed("source", "of")
    rows = sizes.join(per, F.col("source").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", times(F.col("id"), seed).alias("copies"))


def mix(df: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of `df` as often as `taken` says, with all its columns, of
    any name. Null, empty and long texts, null sources and ids, repeated rows and empty
    tables are as there."""
    sizes = sized(df, id_col, text_col, source_col)
    per = planned(sizes, seed)
    forget(sizes)
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source_col).alias("mine"), F.col(id_col).alias("id"))
    rows = row.join(per.withColumnRenamed("source", "of"), F.col("mine").eqNullSafe(F.col("of"))).withColumn("copies", times(F.col("id"), seed)).where("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN (3 * source_size)::DOUBLE
    ELSE (max(CASE WHEN ratio > level THEN level END) OVER ()) * weight END AS target
  FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM t
), c AS (
  SELECT d.doc_id, d.size, p.source, turn, floor(rate)::BIGINT + (('0x' || substr(md5(concat_ws(':', 'mix', turn::VARCHAR, d.doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT AS copies
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, range({SEEDS}) turns(turn)
), w AS (
  SELECT c.source, turn, row_number() OVER (PARTITION BY c.source ORDER BY abs(sum(size * copies)::BIGINT::DOUBLE - any_value(target)), turn) AS place
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source GROUP BY c.source, turn
)
SELECT c.doc_id, c.size, p.source_size, p.target, (c.size * c.copies)::BIGINT AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source JOIN w ON w.source IS NOT DISTINCT FROM c.source AND w.turn = c.turn AND w.place = 1
"""
