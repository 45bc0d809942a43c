"""Filters of bounded size, tested where rows lie, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkose.storage import fresh, settled

#: A filter has at most 2^MOST_BITS bits (2 MiB), whatever the number of its hashes.
MOST_BITS = 24


def _words(hashes: DataFrame, bits: int) -> DataFrame:
    """Of a table of one column of longs: (w, bits), the set bits in words of 64."""
    of = F.pmod(F.col(hashes.columns[0]), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (of % 64).cast("int"))
    return hashes.groupBy(F.shiftright(of, 6).alias("w")).agg(F.bit_or(one).alias("bits"))


def member_test(hashes: DataFrame, per_hash: int = 64):
    """A function of a Column of longs: whether it may be one of `hashes` (a table of one
    column). It never says no to one of them, and seldom yes to another.

    The bits are one value that Spark computes before the plan that uses it, and hands
    to each executor once. There are `per_hash` for each hash, as a power of two, but never
    more than 2^MOST_BITS: with more hashes the test lets more rows through and is still
    right. No hashes let nothing through; null is none of them.
    """
    n = hashes.count()
    bits = min(MOST_BITS, max(6, (max(n, 1) * per_hash - 1).bit_length()))
    words = hashes.sparkSession.range(1 << (bits - 6)).join(settled(_words(hashes.where(F.col(hashes.columns[0]).isNotNull()), bits)), F.col("id") == F.col("w"), "left")
    one = F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    array = words.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["bits"]).alias("a")).scalar()

    def test(c: Column) -> Column:
        at = F.pmod(c, F.lit(1 << bits))
        return F.getbit(F.get(array, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1

    return test


def parted(df: DataFrame, key: Column, keys: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` whose key may be one of `keys` (a table of one column), and the rows
    whose key is none of them. No row is shuffled for it.

    The keys set bits of a filter of 2^bits bits. It is joined as a table of at most
    2^(bits - 6) rows, which bounds what is broadcast whatever the number of keys; with
    very many keys the first part grows to all rows, and is still right.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    w, b = fresh(df, "w"), fresh(df, "bits")
    words = settled(_words(keys.select(F.xxhash64(F.col(keys.columns[0])).alias("h")), bits)).toDF(w, b)
    marked = df.join(F.broadcast(words), F.shiftright(at, 6) == F.col(w), "left")
    hit = F.coalesce(F.getbit(F.col(b), (at % 64).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(hit).select(columns), marked.where(~hit).select(columns)
