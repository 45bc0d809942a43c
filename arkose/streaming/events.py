"""Event time: windows in batch and stream, late data, keyed state, stream joins.

A stream query runs until its input is used up and returns what its sink then holds.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from arkose.registry import Registry, money
from arkose.sources.formats import numbers
from arkose.storage import shared_dir

R = Registry()
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream(t, name: str = "events") -> DataFrame:
    """The table as a stream of files, ts (if it has one) as a timestamp for watermarks."""
    batch = getattr(t, name)
    s = t.spark.readStream.schema(batch.schema).parquet(f"{t.dir}/{name}.parque[t]")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def used_up(df: DataFrame, mode: str = "append", once: bool = False) -> DataFrame:
    """The rows that files in the shared folder hold after all available input; nothing
    passes through the driver. In update mode the rows of all batches, in complete mode
    those of the last one. A batch that comes again replaces itself. `once` ends after one
    batch: state with processing times would ask for empty batches for ever."""
    spark, out = df.sparkSession, shared_dir(df.sparkSession)
    q = df.writeStream.outputMode(mode).option("checkpointLocation", shared_dir(spark)).trigger(**({"once": True} if once else {"availableNow": True}))
    if mode == "append":
        q.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    numbers_seen: set[int] = set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        numbers_seen.add(number)

    q.foreachBatch(keep).start().awaitTermination()
    wanted = sorted(numbers_seen)[-1:] if mode == "complete" else sorted(numbers_seen)
    return spark.read.schema(df.schema).parquet(*[f"{out}/{n}" for n in wanted]) if wanted else spark.createDataFrame([], df.schema)


def ended(t, *kinds: str) -> DataFrame:
    """The events as a stream with events of user -1 in 2100, of the given kinds, in the same
    batch: after it the watermark has passed all windows and timers of the others."""
    s, out = stream(t), shared_dir(t.spark)
    given = {"ts": "TIMESTAMP '2100-01-01'", "user_id": "-1L", "event_id": "-1L", "event_type": "kind"}
    last = t.spark.createDataFrame([(k,) for k in kinds], "kind string")
    last.select(*[F.expr(given.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in s.schema]).write.parquet(out)
    return s.union(t.spark.readStream.schema(s.schema).parquet(out))


@contextmanager
def rocks(spark):
    """The state store that timers and lists need, for the time of a query."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, *aggregates: Column) -> DataFrame:
    """Rows of one session follow each other by at most `gap`."""
    return df.groupBy(*keys, F.session_window(time, gap).alias("s")).agg(*aggregates).withColumns({"start": F.col("s.start"), "end": F.col("s.end")}).drop("s")


@R.query("SELECT event_id, event_type FROM events")
def a4_file_stream(t):
    return used_up(stream(t).select("event_id", "event_type"))


@R.query("SELECT event_id, value FROM events WHERE value > 50")
def a5_foreach_batch(t):
    out = shared_dir(t.spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that comes again replaces itself

    q = stream(t).where("value > 50").select("event_id", "value").writeStream.foreachBatch(keep).option("checkpointLocation", shared_dir(t.spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema("event_id long, value double, batch int").parquet(out).drop("batch")


@R.query("SELECT event_id, user_id FROM events")
def a5_file_sink(t):
    out = shared_dir(t.spark)
    stream(t).select("event_id", "user_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(t.spark)).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id long, user_id long").parquet(out)


@R.query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def a5_table_sink(t):
    name = f"arkose_{uuid.uuid4().hex}"
    q = stream(t).where("event_type = 'error'").select("event_id", "event_type").writeStream.option("checkpointLocation", shared_dir(t.spark)).option("path", shared_dir(t.spark)).trigger(availableNow=True).toTable(name)
    q.awaitTermination()
    return t.spark.table(name)


@R.query("SELECT c_custkey, range * range AS square FROM range(100) JOIN customer ON c_custkey = range")
def a6_custom_stream_source(t):
    """A stream of a source of our own joined with customers; it ends when the source has
    given all it has."""
    numbers(t.spark)  # registers the source
    s, out = t.spark.readStream.format("arkose_numbers").option("rows", 100).load(), shared_dir(t.spark)
    found = s.join(t.customer, F.col("n") == F.col("c_custkey")).select("c_custkey", "square")
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(t.spark)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.read.schema(found.schema).parquet(out)


_HOURLY = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, sum(cast(value as decimal(18,2)))::DOUBLE AS total FROM events GROUP BY ALL"


def _hourly(df):
    return df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@R.query(_HOURLY)
def i1_tumbling(t):
    return _hourly(t.events)


@R.query(_HOURLY)
def i1_tumbling_stream(t):
    return used_up(_hourly(stream(t).withWatermark("ts", "10 minutes")), "complete")


_SLIDING = "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - range * INTERVAL 15 MINUTE AS start FROM events, range(4)) GROUP BY start"


def _sliding(df):
    return df.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@R.query(_SLIDING)
def i2_sliding(t):
    return _sliding(t.events)


@R.query(_SLIDING)
def i2_sliding_stream(t):
    return used_up(_sliding(stream(t)), "complete")


_SESSIONS = """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""


@R.query(_SESSIONS)
def i3_sessions(t):
    return sessions(t.events, ["user_id"], "ts", "30 minutes", F.count("*").alias("n"))


@R.query(_SESSIONS)
def i3_sessions_stream(t):
    """Append mode: sessions that the watermark has closed."""
    found = sessions(ended(t, "end").withWatermark("ts", "10 minutes"), ["user_id"], "ts", "30 minutes", F.count("*").alias("n"))
    return used_up(found).where("user_id >= 0").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.query(_HOURLY)
def i4_watermark_append(t):
    """Append mode: windows end when the watermark passes them; later rows are dropped."""
    return used_up(_hourly(ended(t, "end").withWatermark("ts", "10 minutes"))).where("event_type <> 'end'")


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def i5_dedup_stream(t):
    s = stream(t).withWatermark("ts", "365 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return used_up(s.select("user_id", "event_type"))


_PER_USER = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id"


@R.query(_PER_USER)
def i6_keyed_state(t):
    def count(key, frames, state: GroupState):
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    s = stream(t).select("user_id").groupBy("user_id").applyInPandasWithState(count, "user_id long, n long", "n long", "update", GroupStateTimeout.NoTimeout)
    return used_up(s, "update").groupBy("user_id").agg(F.max("n").alias("n"))


@R.query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def i7_transform_with_state(t):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    class Counter(StatefulProcessor):
        """A value and a map of state for each key."""

        def init(self, handle):
            self.n = handle.getValueState("n", StructType([StructField("n", LongType())]))
            self.kinds = handle.getMapState("kinds", StructType([StructField("kind", StringType())]), StructType([StructField("n", LongType())]))

        def handleInputRows(self, key, rows, timers):
            n = self.n.get()[0] if self.n.exists() else 0
            for f in rows:
                n += len(f)
                for kind in f["event_type"].unique():
                    self.kinds.updateValue((kind,), (1,))
            self.n.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "kinds": [sum(1 for _ in self.kinds.keys())]})

        def close(self):
            pass

    with rocks(t.spark):
        s = stream(t).select("user_id", "event_type").groupBy("user_id").transformWithStateInPandas(Counter(), "user_id long, n long, kinds long", "Update", "None")
        return used_up(s, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("kinds").alias("kinds"))


@R.query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events) WHERE ts < first + INTERVAL 24 HOUR GROUP BY user_id")
def i7_list_and_timers(t):
    """The first day of each user: a list keeps its events until an event-time timer ends it."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class FirstDay(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.kept = handle.getListState("kept", "event_id long, us long")

        def handleInputRows(self, key, rows, timers):
            for f in rows:
                self.kept.appendList([(int(e), int(us)) for e, us in zip(f["event_id"], f["us"])])
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(min(us for _, us in self.kept.get()) // 1000 + 86_400_000)
            yield pd.DataFrame({"user_id": [], "n": [], "last": []}).astype("int64")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            kept = list(self.kept.get())
            first = min(us for _, us in kept)
            ids = [e for e, us in kept if us < first + 86_400_000_000]
            self.kept.clear()
            yield pd.DataFrame({"user_id": [key[0]], "n": [len(ids)], "last": [max(ids)]})

        def close(self):
            pass

    with rocks(t.spark):
        s = ended(t, "end").select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", "10 minutes")
        return used_up(s.groupBy("user_id").transformWithStateInPandas(FirstDay(), "user_id long, n long, last long", "Append", "EventTime"))


@R.query(_PER_USER)
def i7_state_with_ttl(t):
    """State that the store removes a day after its last change; a run is shorter."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Counter(StatefulProcessor):
        def init(self, handle):
            self.n = handle.getValueState("n", "n long", 86_400_000)

        def handleInputRows(self, key, rows, timers):
            n = (self.n.get()[0] if self.n.exists() else 0) + sum(len(f) for f in rows)
            self.n.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

        def close(self):
            pass

    with rocks(t.spark):
        s = stream(t).select("user_id").groupBy("user_id").transformWithStateInPandas(Counter(), "user_id long, n long", "Update", "ProcessingTime")
        return used_up(s, "update", once=True).groupBy("user_id").agg(F.max("n").alias("n"))


def counted_halves(t, ttl: int | None) -> DataFrame:
    """(user_id, n) of the second of two runs of one stream: counts of a user's events, kept
    for `ttl` milliseconds after their last change, or for ever. The first run has the events
    of even ids; the second one goes on from its checkpoint after the time has passed."""
    import time

    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Counter(StatefulProcessor):
        def init(self, handle):
            self.n = handle.getValueState("n", "n long", ttl) if ttl else handle.getValueState("n", "n long")

        def handleInputRows(self, key, rows, timers):
            n = (self.n.get()[0] if self.n.exists() else 0) + sum(len(f) for f in rows)
            self.n.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

        def close(self):
            pass

    spark, files, checkpoint, out = t.spark, *(shared_dir(t.spark) for _ in range(3))
    with rocks(spark):
        for half in (0, 1):
            if half and ttl:
                time.sleep(1.5 * ttl / 1000)
            t.events.where(F.col("event_id") % 2 == half).select("user_id").write.mode("append").parquet(files)
            users = spark.readStream.schema("user_id long").parquet(files).groupBy("user_id")
            counts = users.transformWithStateInPandas(Counter(), "user_id long, n long", "Update", "ProcessingTime")
            keep = lambda batch, _, to=f"{out}/{half}": batch.write.mode("overwrite").parquet(to)
            counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(once=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema("user_id long, n long").parquet(f"{out}/1").groupBy("user_id").agg(F.max("n").alias("n"))


@R.query("SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY user_id")
def i7_expired_state(t):
    """The first run's counts have expired when the second begins, so it counts from 0."""
    return counted_halves(t, 2000)


@R.query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 2 = 1) > 0")
def i7_kept_state(t):
    """The same stream without an expiry: the second run goes on from the first's counts."""
    return counted_halves(t, None)


@R.query("SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def c15_stream_stream_join(t):
    s = stream(t)
    c = s.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("ct")).withWatermark("ct", "2 hours")
    p = s.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("w"), F.col("ts").alias("pt")).withWatermark("pt", "2 hours")
    return used_up(c.join(p, F.expr("u = w AND pt BETWEEN ct AND ct + INTERVAL 1 HOUR")).select("click_id", "purchase_id"))


@R.query("SELECT v.event_id AS view_id, e.event_id AS error_id FROM events v LEFT JOIN events e ON v.user_id = e.user_id AND e.event_type = 'error' AND e.ts BETWEEN v.ts AND v.ts + INTERVAL 30 MINUTE WHERE v.event_type = 'view'")
def i8_stream_stream_join(t):
    """An outer join: rows without a match come when the watermark has passed their time."""
    s = ended(t, "view", "error")
    v = s.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("u"), F.col("ts").alias("vt")).withWatermark("vt", "1 hour")
    e = s.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("w"), F.col("ts").alias("et")).withWatermark("et", "1 hour")
    joined = v.join(e, F.expr("u = w AND et BETWEEN vt AND vt + INTERVAL 30 MINUTE"), "left_outer")
    return used_up(joined.select("view_id", "error_id")).where("view_id >= 0")


@R.query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def c15_stream_static_join(t):
    return used_up(stream(t).where("event_type = 'purchase'").join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@R.query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def i9_update_mode(t):
    """Update mode repeats a group as it grows; the last count is the largest."""
    return used_up(stream(t).groupBy("event_type").agg(F.count("*").alias("n")), "update").groupBy("event_type").agg(F.max("n").alias("n"))


@R.query("SELECT user_id, event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS whole FROM events")
def i3_gaps(t):
    """Seconds since a user's last event, by second boundaries."""
    w = Window.partitionBy("user_id").orderBy("ts")
    sec = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return t.events.select("user_id", "event_id", F.timestamp_diff("SECOND", F.lag(sec).over(w), sec).alias("whole"))
