"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir (or the folder of setCheckpointDir),
    which driver and executors share.

    Where neither is set, a session on one machine (tests) gets a temporary folder; on a
    cluster that is an error, as executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = shared_dir.own = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="arkose-")
    return f"{root}/arkose/{uuid.uuid4().hex}"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def settled(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends here, and the
    result survives the loss of any executor. Its columns' names are kept, whatever
    they are."""
    path, names = shared_dir(df.sparkSession), [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    plain.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._arkose_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes what `settled` has written of tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._arkose_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
