"""The queries opN_* and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkose.llm import chat, common, media, mixing, packing, pii, quality, resampling, simhash, token_counts, token_store, vector_search, warc, whitening

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(common.table(spark, sf_dir, "documents"), BYTE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded media are written and read back; the resampled PCM is a column of the
    result, stored where the result is."""
    stored = common.settled(media.store(common.table(spark, sf_dir, "documents")), "zstd")
    return media.analysed(stored, with_pcm=True)


@query
def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op4_top_k_search"] = vector_search.ORACLE


@query
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.shared_dir(spark)
    token_store.write_tokens(common.table(spark, sf_dir, "documents"), BYTE_BPE, out)
    return token_store.read_tokens(spark, out)


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(common.table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    sha = F.sha2(pii.listed(F.col("base")), 256)
    return found.select("doc_id", *map(number, pii.KINDS), sha.alias("base_sha256"), pii.listed(F.concat("base", "extra")).alias("spans"))


@query
def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preferences(chat.last_answers(common.table(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


ORACLES["op9_preferences"] = chat.ORACLE


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op10_mixing"] = mixing.ORACLE


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(common.table(spark, sf_dir, "embeddings"))


@query
def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.shared_dir(spark)
    warc.write_archive(common.table(spark, sf_dir, "pages"), out)
    return warc.read_archive(spark, out)


ORACLES["op12_warc_archive"] = warc.ORACLE


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_resampling"] = resampling.ORACLE
