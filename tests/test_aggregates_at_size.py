"""Aggregates on rows that the small tables do not have: many keys, ties and nulls."""

import pyarrow.parquet as pq

from arkose.operators import aggregates
from tests.compare import assert_equal


def test_sketches_are_near_with_many_keys(spark, tmp_path):
    """At this number of keys a sketch of 5 % standard error is 10.07 % off."""
    path, name = str(tmp_path), "d12_sketches"
    spark.range(1_200_000).toDF("l_partkey").write.parquet(f"{path}/lineitem.parquet")
    row = aggregates.R.queries[name](spark, path).first()
    assert row.asDict() == {"exact": 1_200_000, "hll_near": True, "sketch_near": True, "theta_near": True}


def test_max_by_with_ties_and_nulls(spark, tmp_path):
    """Ties go to the first event, in whatever order Spark gets the rows; DuckDB, on one
    small file in order of event_id, takes the first, too."""
    path, name = str(tmp_path), "d13_max_by"
    rows = [(e, e % 4, u, k, v) for u in range(3) for e, k, v in zip(range(100 * u, 100 * u + 60), "abc" * 20, [1.0, 7.0, 7.0, None, 2.0] * 12)]
    rows += [(900, 1, 7, "x", None), (901, 1, 7, "y", None), (902, 1, 8, None, 9.0), (903, 1, 8, "z", 3.0), (904, None, 8, "z", 3.0), (905, 1, 9, "n", float("nan")), (906, 2, 9, "m", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts int, user_id long, event_type string, value double")
    pq.write_table(df.toArrow(), f"{path}/events.parquet")
    assert_equal(aggregates.R.queries[name](spark, path), path, aggregates.R.oracles[name])
    other = tmp_path / "shuffled"
    other.mkdir()
    df.orderBy("event_type", "event_id", ascending=False).write.parquet(f"{other}/events.parquet")
    assert_equal(aggregates.R.queries[name](spark, str(other)), path, aggregates.R.oracles[name])
