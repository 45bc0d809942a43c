"""Sources and sinks: file formats, partitioned and bucketed tables, a custom source."""

from __future__ import annotations

import uuid

import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from arkose.registry import Registry
from arkose.storage import shared_dir

R = Registry()


def round_trip(df: DataFrame, kind: str, **options) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def bucketed(df: DataFrame, key: str, buckets: int = 8) -> DataFrame:
    """`df` as a table of the warehouse in buckets of `key`, sorted in each."""
    name = f"arkose_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).saveAsTable(name, path=shared_dir(df.sparkSession))
    return df.sparkSession.table(name)


@R.query("SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'A'")
def a1_scan_pushdown(t):
    return t.lineitem.where((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "A")).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


def _format(kind, **options):
    def run(t):
        return round_trip(t.orders, kind, **options)

    run.__name__, run.__doc__ = f"a2_{kind}_round_trip", f"Orders written as {kind} and read with their schema."
    R.query("SELECT * FROM orders")(run)


_format("csv", header=True)
_format("json")
_format("orc")
_format("parquet", compression="zstd")
_format("xml", rowTag="order")


@R.query("SELECT o_orderkey AS value FROM orders")
def a2_text_round_trip(t):
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("value"))
    return round_trip(rows, "text").select(F.col("value").cast("bigint").alias("value"))


@R.query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def a3_partition_pruning(t):
    path = shared_dir(t.spark)
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).where("o_orderstatus = 'F'")


class _Part(InputPartition):
    def __init__(self, start, stop):
        super().__init__(start)
        self.start, self.stop = start, stop


class _Numbers(DataSource):
    """Numbers and their squares; options: rows, parts. Reads and streams."""

    @classmethod
    def name(cls):
        return "arkose_numbers"

    def schema(self):
        return "n long, square long"

    def reader(self, schema):
        return _NumbersReader(int(self.options.get("rows", 1000)), int(self.options.get("parts", 4)))

    def streamReader(self, schema):
        return _NumbersStream(int(self.options.get("rows", 1000)))


class _NumbersReader(DataSourceReader):
    def __init__(self, rows, parts):
        self.rows, self.parts = rows, parts

    def partitions(self):
        return [_Part(self.rows * i // self.parts, self.rows * (i + 1) // self.parts) for i in range(self.parts)]

    def read(self, part):
        for n in range(part.start, part.stop):
            yield n, n * n


class _NumbersStream(DataSourceStreamReader):
    """All rows in two batches."""

    def __init__(self, rows):
        self.rows, self.at = rows, 0

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        self.at = min(self.rows, self.at + -(-self.rows // 2))
        return {"n": self.at}

    def partitions(self, start, end):
        return [_Part(start["n"], end["n"])]

    def read(self, part):
        for n in range(part.start, part.stop):
            yield n, n * n


class _Written(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class _Files(DataSource):
    """A sink: each task writes a Parquet file of its own beside the folder `path`, and the
    commit renames the files of the tasks that count into it. Tasks that ran twice or
    failed leave nothing there. Any file system that Arrow knows will do."""

    @classmethod
    def name(cls):
        return "arkose_files"

    def writer(self, schema, overwrite):
        return _FilesWriter(self.options["path"], schema)


class _FilesWriter(DataSourceArrowWriter):
    def __init__(self, path, schema):
        self.path, self.schema = path, to_arrow_schema(schema)

    def _at(self, *names):
        system, root = fs.FileSystem.from_uri(self.path)
        return system, "/".join([root.rstrip("/"), *names])

    def write(self, batches):
        system, folder = self._at("_tasks")
        system.create_dir(folder, recursive=True)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{name}", self.schema, filesystem=system)
            writer.write_batch(batch.cast(self.schema))
        if writer is not None:
            writer.close()
        return _Written(name if writer is not None else None)

    def commit(self, messages):
        system, folder = self._at()
        for m in messages:
            if m is not None and m.name:
                system.move(f"{folder}/_tasks/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        system, folder = self._at("_tasks")
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def sink(df: DataFrame) -> str:
    """Writes `df` through the sink into a fresh shared folder, whose path is returned."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    spark.dataSource.register(_Files)
    df.write.format("arkose_files").option("path", path).mode("append").save()
    return path


@R.query("SELECT * FROM orders")
def a6_custom_sink(t):
    """Orders written by the tasks, committed by renaming, and read back by Spark."""
    return t.spark.read.schema(t.orders.schema).parquet(sink(t.orders))


def numbers(spark, rows: int = 1000) -> DataFrame:
    spark.dataSource.register(_Numbers)
    return spark.read.format("arkose_numbers").options(rows=rows).load()


@R.query("SELECT range AS n, range * range AS square, count(*) AS orders FROM range(1000) JOIN orders ON o_custkey % 1000 = range GROUP BY ALL")
def a6_custom_source(t):
    """Rows of a source of our own, read in parts, joined with the orders."""
    counts = t.orders.groupBy((F.col("o_custkey") % 1000).alias("n")).agg(F.count("*").alias("orders"))
    return numbers(t.spark).join(counts, "n")


@R.query("SELECT k, name, n_name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(k, name) JOIN nation ON n_regionkey = k")
def a7_inline_rows(t):
    values = t.spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(k, name)")
    return t.nation.join(values, F.col("n_regionkey") == F.col("k")).select("k", "name", "n_name")


@R.query("SELECT k, name, count(*) AS n FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(k, name) JOIN orders ON o_orderkey % 4 = k GROUP BY k, name")
def a7_created_frame(t):
    """Rows of the program; their number is fixed."""
    rows = t.spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, name string")
    return t.orders.join(F.broadcast(rows), F.col("o_orderkey") % 4 == F.col("k")).groupBy("k", "name").agg(F.count("*").alias("n"))
