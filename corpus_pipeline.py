"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last keep the columns of documents and further ones,
of any name. A stage bounds the bytes that Spark hands workers at once, in its session.

In all stages a null text counts as empty and stays null, texts of any length are handled
whole, an empty table gives no row, and rows whose id is null or repeated are rows like
others. What else holds of nulls, ties and repeated rows is said at each stage's operator.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arkose.llm import common, mixing, near, packing, pii, quality, simhash

#: The rows depend on trained weights and XXH64, which SQL cannot express.
ORACLE_SQL = None


def stage(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, accepts:
    a score of the threshold or more. Equal texts share their fate; without labels of both
    kinds all documents stay."""
    return quality.accepted(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.
    Links: 0.8 or more of Jaccard on word 5-shingles (not op6's 4 bits of SimHash).
    All texts without words are one group; of repeated ids in a group one row stays."""
    return simhash.first_of_groups(docs, classes_of=near.classes, marks=near.marked)


@stage
def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of its kinds; n_chars follows."""
    return pii.masked(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("PII", mask_private),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = common.settled(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
