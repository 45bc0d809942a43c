"""Late rows, which the tables do not have: files in the wrong order."""

import datetime as dt
import time

from pyspark.sql import functions as F

from arkose.streaming.events import used_up


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    def put(minutes):
        rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m),) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    for minutes in ([0, 5], [200], [211], [3], [400]):  # rows are late by the watermark of the batch before
        put(minutes)
        time.sleep(1.1)  # the source takes files by their time
    s = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = s.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    got = {r.w.start.hour * 60 + r.w.start.minute: r.n for r in used_up(counts).collect()}
    assert got[0] == 2 and got[200] == 1
