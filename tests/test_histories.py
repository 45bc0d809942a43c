"""Windows in ranges and masks against plain versions, on odd rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.operators import histories, masks


def events(spark, n=400):
    rng = random.Random(3)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * rng.randrange(600))
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), at() if rng.random() < 0.97 else None, rng.choice([None, 1, 2, 5])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v int").repartition(5)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_running_sums_in_ranges(spark, unit):
    df = events(spark)
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("ts")))
    assert same(histories.running_sum(df, ["k"], "ts", F.col("v"), "s", unit), want)
    assert histories.running_sum(df.limit(0), ["k"], "ts", F.col("v"), "s").collect() == []


@pytest.mark.parametrize("unit, rows", [("hour", 4), ("day", 1), ("day", 30)])
def test_rows_before_in_ranges(spark, unit, rows):
    df = events(spark)
    made = {"s": F.sum("v"), "n": F.count("*"), "first": F.first("id")}
    frame = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-rows, 0)
    assert same(histories.last_rows(df, ["k"], ["ts", "id"], made, rows, unit), df.withColumns({n: c.over(frame) for n, c in made.items()}))
    assert histories.last_rows(df.limit(0), ["k"], ["ts", "id"], made, rows).collect() == []


def test_intervals_in_ranges(spark):
    df = events(spark)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    for seconds in (900, 86_400):
        frame = Window.partitionBy("k").orderBy("m").rangeBetween(-seconds * 1_000_000, 0)
        want = df.withColumn("m", micros).withColumn("n", F.count("*").over(frame)).drop("m")
        assert same(histories.interval_counts(df, ["k"], "ts", seconds, "n"), want)


def test_no_task_has_a_whole_history(spark):
    """Windows over rows are by key and range; those by key alone have one row a range."""
    df = events(spark)
    plans = [histories.running_sum(df, ["k"], "ts", F.col("v"), "s"), histories.interval_counts(df, ["k"], "ts", 86_400, "n")]
    for out in plans:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        by_row = [line for line in plan.splitlines() if "Window [" in line and "__r" not in line and "__at" not in line]
        assert not by_row, by_row


def plain_masked(text):
    lines = []
    for line in text.split("\n"):
        line = re.sub("[\x01\x02]", " ", line)
        found = sorted((m.start(), i, m.end(), n) for i, (n, p) in enumerate(masks.PATTERNS.items()) for m in re.finditer(p, line))
        runs = []
        for a, _, b, n in found:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b, n])
        out, at = "", 0
        for a, b, n in runs:
            out, at = f"{out}{line[at:a]}<{n}>", b
        lines.append(out + line[at:])
    return "\n".join(lines)


def test_masks_equal_a_plain_version(spark):
    key = "0123456789abcdef" * 3
    texts = ["", "\n", "nothing here", "mail a@b.org,c@d.net or 10.0.0.1\nkey=" + key, "SPDX-License-Identifier: MIT\nx a@b.c", "é ü a@b.org 日本 +1 (202) 555-0101.", "1.2.3.4.5 " + key + "@x.org", "a@b.org" * 3, "a@b.org_x@y.zz", "u" * 9_000, "words and " * 3_000, ("word " * 50 + "10.1.2.3 ") * 200, "line\n" * 3000 + "Copyright 2020 x@y.zz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = {r.i: r.m for r in df.select("i", masks.masked(F.col("text")).alias("m")).collect()}
    assert got == {**{i: plain_masked(t) for i, t in enumerate(texts)}, len(texts): None}
    plan = df.select(masks.masked(F.col("text")))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Exchange", "Window"))
