"""What Spark hands a worker at once in the pipeline is bounded by bytes, not only by rows."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arkose.llm.common import BYTES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("place", range(5))
def test_batches_are_bounded_by_bytes(spark, place):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    own = spark.newSession()
    docs = own.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.STAGES[place][1](own, docs.limit(0), SF)
    wide = own.range(0, 3000, 1, 1).select(F.repeat(F.lit("0123456789"), 800).alias("text"))  # 24 MB in one task
    seen = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in seen) == 3000 and max(r["size"] for r in seen) < 2 * BYTES
