"""Operators of the library on rows that the tables lack: nulls, ties, empty input."""

import datetime as dt

from pyspark.sql import functions as F

from arkose.operators.joins import asof_join, hot_keys, interval_join, not_in, salted_join, skew_join
from arkose.operators.ordered import before, numbered
from arkose.operators.text import first_copies, word_runs
from arkose.operators.windows import top_k_per_group
from arkose.streaming.events import sessions


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_asof_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, "b", at(9)), (4, None, at(9))], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 10), ("a", at(3), 11), ("a", at(6), 12), ("a", at(5), 13), ("c", at(0), 14)], "k string, rt timestamp_ntz, v int")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {1: 13, 2: None, 3: None, 4: None}
    assert asof_join(left.limit(0), right, ["k"], "t", "rt", ["v"]).count() == 0


def test_asof_with_nulls_and_ranges(spark):
    left = spark.createDataFrame([(1, None, at(5)), (2, "a", None), (3, "a", at(5)), (4, "a", at(3000))], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([(None, at(1), 10), ("a", None, 11), ("a", at(9), 12), ("a", at(2), None), ("b", at(1), 13)], "k string, rt timestamp_ntz, v int")
    for ranges in (None, "hour", "day"):
        got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"], ranges).collect()}
        assert got == {1: None, 2: None, 3: None, 4: 12}


def test_not_in_as_sql_has_it(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    of = lambda *v: sorted(str(r.x) for r in not_in(left, "x", spark.createDataFrame([(i,) for i in v], "y int")).collect())
    assert of(2, 5) == ["1"] and of(2, None) == [] and of() == ["1", "2", "None"]


def test_running_sums_over_ranges(spark):
    import random

    values = [random.Random(i).choice([None, 1, 2, 3]) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(7)
    got = {r.i: (r.n, r.total) for r in before(df, [F.col("v").asc_nulls_last(), F.col("i").desc()], {"n": F.lit(1), "total": F.col("v")}).collect()}
    n = total = 0
    for i, v in sorted(enumerate(values), key=lambda x: (x[1] is None, x[1] or 0, -x[0])):
        assert got[i] == (n, total)
        n, total = n + 1, total + (v or 0)
    assert before(df.limit(0), [F.col("i").asc()], {"n": F.lit(1)}).collect() == []


def test_numbers_over_ranges(spark):
    import random

    values = [random.Random(i).choice([None, 1, 2, 3]) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(7)
    got = {r.i: r.place for r in numbered(df, [F.col("v").desc_nulls_last(), F.col("i").asc()], "place").collect()}
    want = sorted(range(300), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert got == {i: n for n, i in enumerate(want, 1)}
    assert numbered(df.limit(0), [F.col("i").asc()], "place").collect() == []
    ties = numbered(spark.createDataFrame([(1,)] * 50, "x int"), [F.col("x").asc()], "place")
    assert sorted(r.place for r in ties.collect()) == list(range(1, 51))


def test_plans_have_no_single_task_or_nested_loop(spark):
    from arkose.operators import joins, relational
    from arkose.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for q in (joins.c3_not_in, joins.c11_asof_by_ranges, joins.c13_richer_in_group, relational.f1_sort_nulls):
        plan = q(t)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("SinglePartition", "NestedLoop", "Cartesian")), q.__name__


def test_interval_join_includes_both_ends(spark):
    left = spark.createDataFrame([(1, at(0)), (2, at(7)), (3, None)], "a int, lt timestamp_ntz")
    right = spark.createDataFrame([(1, at(0)), (2, at(10)), (3, at(11)), (4, at(17)), (5, None)], "b int, rt timestamp_ntz")
    got = sorted((r.a, r.b) for r in interval_join(left, right, "lt", "rt", 600).collect())
    assert got == [(1, 1), (1, 2), (2, 2), (2, 3), (2, 4)]


def test_interval_join_has_no_nested_loop(spark):
    left = spark.createDataFrame([(1, at(0))], "a int, lt timestamp_ntz")
    right = spark.createDataFrame([(1, at(0))], "b int, rt timestamp_ntz")
    plan = interval_join(left, right, "lt", "rt", 600)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_salted_join_loses_no_row(spark):
    large = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y"), (9, "z"), (None, "n")], "k long, name string")
    hot = hot_keys(large, "k", 10)
    assert {r.k for r in hot.collect()} == {1, 2}
    assert salted_join(large, small, "k", 4, F.col("id"), hot).count() == large.join(small, "k").count() == 335


def test_adaptive_execution_splits_a_skewed_key(spark):
    """With small limits for small tables: the partition of the hot key is cut."""
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "2k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "adaptive.skewJoin.skewedPartitionFactor": "1.1", "shuffle.partitions": "16"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    large = spark.range(30_000).repartition(8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    other = spark.range(60_000).select((F.col("id") % 30_000).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        joined = skew_join(large, other, "k")
        assert len(joined.collect()) == 30_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_hot_key_of_the_skewed_lines_is_salted(spark):
    from arkose.operators import joins
    from arkose.registry import Tables

    lines, _ = joins._skewed(Tables(spark, "/root/testdata/sf0.001"))
    assert [r.k for r in hot_keys(lines, "k", 100).collect()] == [1]


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 0, 3), (None, 5, 4)], "g string, v int, id int")
    got = sorted((str(r.g), r.id) for r in top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 2).collect())
    assert got == [("None", 4), ("a", 1), ("a", 2)]


def test_sessions_join_at_exactly_the_gap(spark):
    df = spark.createDataFrame([("u", at(0)), ("u", at(30)), ("u", at(61)), (None, at(0))], "k string, ts timestamp_ntz")
    got = sorted((str(r.k), r.n) for r in sessions(df, ["k"], "ts", "30 minutes", F.count("*").alias("n")).collect())
    assert got == [("None", 1), ("u", 1), ("u", 2)]


def test_first_copies_and_grams(spark):
    df = spark.createDataFrame([(3, "a b c"), (1, "a b c"), (2, None), (5, None), (4, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in first_copies(df, "doc_id", "text").collect()) == [1, 2, 4]
    assert word_runs(df, "doc_id", 3).count() == 2
    assert word_runs(df, "doc_id", 4).count() == 0


def test_scans_push_down(spark):
    from arkose.registry import Tables
    from arkose.sources.formats import a1_scan_pushdown

    plan = a1_scan_pushdown(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan or "GreaterThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[-1]
