import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from arkose.registry import Tables
from arkose.sources import formats
from arkose.sources.formats import bucketed, numbers, round_trip, sink
from arkose.storage import shared_dir


def test_custom_source_reads_all_partitions(spark):
    assert sorted(r.n for r in numbers(spark, 37).collect()) == list(range(37))


def test_custom_sink_commits_what_counts(spark):
    df = numbers(spark, 100).union(numbers(spark, 0)).withColumn("none", F.lit(None).cast("string"))
    path = sink(df)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, df.collect()))
    system, root = pyarrow.fs.FileSystem.from_uri(path)
    names = [f.base_name for f in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))]
    assert names and all(n.endswith(".parquet") for n in names)


def test_failed_write_leaves_nothing(spark):
    df = numbers(spark, 100).withColumn("square", F.when(F.col("n") == 77, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("square")))
    path = shared_dir(spark)
    spark.dataSource.register(formats._Files)
    with pytest.raises(Exception, match="stop"):
        df.write.format("arkose_files").option("path", path).mode("append").save()
    system, root = pyarrow.fs.FileSystem.from_uri(path)
    assert [f for f in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file] == []


def test_partitions_are_pruned(spark):
    plan = formats.a3_partition_pruning(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan and "o_orderstatus#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_formats_keep_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None, 1.5), (None, "ü,\"x\"\ny", None)], "a long, b string, c double")
    for kind, options in (("json", {}), ("orc", {}), ("parquet", {}), ("csv", {"header": True, "multiLine": True, "escape": '"'})):
        assert sorted(map(str, round_trip(df, kind, **options).collect())) == sorted(map(str, df.collect())), kind


def test_bucketed_join_has_no_exchange(spark):
    a, b = bucketed(spark.range(100).withColumnRenamed("id", "k"), "k"), bucketed(spark.range(50).withColumnRenamed("id", "m"), "m")
    joined = a.hint("merge").join(b, a.k == b.m)
    assert joined.count() == 50
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().toString()
