"""User-defined functions of every kind; built-in functions come first elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from arkose.registry import Registry
from arkose.shipping import shipped

R = Registry()


@R.query("SELECT c_custkey, length(c_name) * 2 AS n FROM customer")
def j1_python_udf(t):
    return t.customer.select("c_custkey", F.udf(lambda s: None if s is None else len(s) * 2, "bigint")("c_name").alias("n"))


@R.query("SELECT event_id, value * 2 + 1 AS v FROM events")
def j2_pandas_udf(t):
    @F.pandas_udf("double")
    def twice(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return t.events.select("event_id", twice("value").alias("v"))


@R.query("SELECT event_id, upper(event_type) AS kind FROM events")
def j2_arrow_udf(t):
    @F.arrow_udf("string")
    def up(v: pa.Array) -> pa.Array:
        return pc.utf8_upper(v)

    return t.events.select("event_id", up("event_type").alias("kind"))


class Aggregate:
    """A user's aggregate whose states can be merged: what the rows of one batch and key
    fold into, and what two states make. `state` and `result` are DDL columns."""

    state = result = ""

    def fold(self, values: np.ndarray) -> tuple:
        raise NotImplementedError

    def merge(self, a: tuple, b: tuple) -> tuple:
        raise NotImplementedError

    def finish(self, state: tuple) -> tuple:
        return state


#: Keys whose states a task holds at once; then it passes them on and begins anew.
MOST_STATES = 100_000


@shipped
def aggregated(df: DataFrame, key: str, value: str, by: Aggregate, most: int = MOST_STATES) -> DataFrame:
    """Per key of `df` its aggregate: key and the columns of by.result.

    Each task folds its batches into one state a key, and only states are shuffled. Of a
    key they come one after another and are merged as they come, so a task holds two of
    them at most, however many rows the key has. Null values are no rows, but a key of
    nulls only has no state and no row; a null key is a key. An empty table gives no row.
    """
    kind = df.schema[key].dataType
    states = StructType([StructField("key", kind), *StructType.fromDDL(by.state)])
    results = StructType([StructField("key", kind), *StructType.fromDDL(by.result)])

    def rows(found: dict, schema) -> pa.RecordBatch:
        columns = zip(*[(k, *s) for k, s in found.items()]) if found else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, to_arrow_schema(schema).types)], names=schema.names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            codes = pc.fill_null(batch.column(0).dictionary_encode(null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False)
            names = batch.column(0).dictionary_encode(null_encoding="encode").dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            values = batch.column(1).to_numpy(zero_copy_only=False)[order]
            for code, part in zip(*_runs(codes[order], values)):
                state = by.fold(part)
                held[names[code]] = by.merge(held[names[code]], state) if names[code] in held else state
            if len(held) > most:
                yield rows(held, states)
                held = {}
        yield rows(held, states)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        last, total = none, ()
        for batch in batches:
            done: dict = {}
            for k, *state in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not none and k == last:
                    total = by.merge(total, tuple(state))
                else:
                    if last is not none:
                        done[last] = by.finish(total)
                    last, total = k, tuple(state)
            yield rows(done, results)
        if last is not none:
            yield rows({last: by.finish(total)}, results)

    source = df.where(F.col(f"`{value}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    folded = source.mapInArrow(partial, states)
    return folded.repartition("key").sortWithinPartitions("key").mapInArrow(merged, results).withColumnRenamed("key", key)


def _runs(codes: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, int)
    return codes[starts].tolist(), np.split(values, starts[1:]) if len(codes) else []


class GeometricMean(Aggregate):
    """Of values above -1, each counted as one more, so zeros have a logarithm."""

    state, result = "n long, logs double", "gm double"

    def fold(self, values):
        return len(values), float(np.log1p(values).sum())

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state):
        return (float(np.exp(state[1] / state[0])),)


@R.query("SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS gm FROM events GROUP BY event_type")
def j3_udaf(t):
    """A mergeable aggregate: states are shuffled, no group's rows meet in a worker."""
    return aggregated(t.events, "event_type", "value", GeometricMean()).withColumn("gm", F.round("gm", 6))


@R.query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def j4_udtf(t):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, s: str):
            for w in () if s is None else s.split(" "):
                yield (w,)

    t.spark.udtf.register("arkose_words", Words)
    return t.sql("SELECT p_partkey, word FROM {part}, LATERAL arkose_words(p_name)", "part")


@R.query("SELECT p_partkey, length(p_name)::BIGINT AS letters FROM part")
def j4_arrow_udtf(t):
    """A table function on Arrow columns; null names have null letters."""
    @F.arrow_udtf(returnType="key bigint, letters bigint")
    class Letters:
        def eval(self, rows: pa.RecordBatch):
            table = pa.table({"key": rows.column("p_partkey").cast(pa.int64()), "letters": pc.utf8_length(rows.column("p_name")).cast(pa.int64())})
            yield table

    t.spark.udtf.register("arkose_letters", Letters)
    return t.sql("SELECT key AS p_partkey, letters FROM arkose_letters(TABLE(SELECT p_partkey, p_name FROM {part}))", "part")


@R.query("SELECT user_id, event_id, value - max(value) OVER (PARTITION BY user_id) AS below FROM events")
def j5_grouped_map(t):
    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(below=pdf["value"] - pdf["value"].max())[["user_id", "event_id", "below"]]

    return t.events.select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(below, "user_id long, event_id long, below double")


@R.query("SELECT coalesce(c_nationkey, s_nationkey)::INT AS k, coalesce(c, 0)::BIGINT AS c, coalesce(s, 0)::BIGINT AS s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY ALL) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY ALL) ON c_nationkey = s_nationkey")
def j5_cogrouped_map(t):
    def both(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "c": [len(a)], "s": [len(b)]})

    return t.customer.select("c_nationkey").groupBy("c_nationkey").cogroup(t.supplier.select("s_nationkey").groupBy("s_nationkey")).applyInPandas(both, "k int, c long, s long")


@R.query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def j5_map_in_pandas(t):
    def third(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[f["o_orderkey"] % 3 == 1]

    return t.orders.select("o_orderkey").mapInPandas(third, "o_orderkey long")


@R.query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def j5_map_in_arrow(t):
    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], names=["o_orderkey", "twice"])

    return t.orders.select("o_orderkey", "o_totalprice").mapInArrow(twice, "o_orderkey long, twice double")


@R.query("SELECT p_partkey, p_retailprice * 1.2 AS gross, range AS step FROM part, range(3)")
def j6_sql_functions(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION arkose_gross(x DOUBLE) RETURNS DOUBLE RETURN x * 1.2D")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION arkose_steps(n INT) RETURNS TABLE (step BIGINT) RETURN SELECT id FROM range(3) WHERE id < n")
    return t.sql("SELECT p_partkey, arkose_gross(p_retailprice) AS gross, step FROM {part}, LATERAL arkose_steps(3)", "part")
