"""Null, empty and very long texts, repeated rows, clashing names and empty tables, for the
pipeline's stages and for the operators that read whole texts."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from arkose.llm import chat, mixing, near, packing, pii, queries, simhash, token_counts, token_store
from arkose.llm.common import shared_dir, tokenizer

SF = "/root/testdata/sf0.001"
NAMES = ["a.b", "fp", "row", "bits", "root", "key", "id", "score", "extra"]


def long_text(n=1_100_000):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    out, size = [], 0
    while size < n:
        out.append(rng.choice(words))
        size += len(out[-1]) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def long():
    return long_text()


def odd(spark, long):
    """Documents of the smallest table, and odd ones, with columns of any name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.where("doc_id % 7 = 0")
    rows = [(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (900_003, " \n\t", "en", "x", 3), (None, "no id here", "en", "x", 10), (None, "no id here", "en", "x", 10), (900_004, long, "en", "y", len(long)), (900_005, long + " end", "en", "y", len(long) + 4)]
    made = spark.createDataFrame(rows, docs.schema)
    both = plain.union(made).union(plain.limit(3))
    return both.withColumns({n: F.lit("z") for n in NAMES})


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows(spark, long, place):
    name, stage = corpus_pipeline.STAGES[place]
    docs = odd(spark, long).repartition(4)
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        whole = {r.doc_id: 0 for r in rows}
        for r in rows:
            whole[r.doc_id] += r.length
        assert set(whole) == {d for d, _ in before}
        return
    assert out.columns == docs.columns and all(r["a.b"] == "z" == r.fp for r in rows)
    after = Counter((r.doc_id, r.text) for r in rows)
    if name == "quality classifier":
        assert after <= before and sum(after.values()) > 10
    elif name == "SimHash near-dedup":
        assert after <= before and len(set(after)) == sum(after.values())
        assert sum(d in (900_004, 900_005) for d, _ in after) == 1 and sum((t or "").strip() == "" for _, t in after) == 1
    elif name == "PII":
        assert Counter(d for d, _ in after.elements()) == Counter(d for d, _ in before.elements()) and after[(900_001, None)] == 1
    else:
        assert set(after) <= set(before) and max(after.values()) <= 3 * max(before.values())


@pytest.mark.parametrize("place", range(5))
def test_stages_take_no_rows(spark, place):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[place][1](spark, docs, SF).collect() == []


def test_a_long_text_is_read_whole(spark, long):
    """Of a text over 1 MB, what each operator says of all of it."""
    df = spark.createDataFrame([(1, long), (2, None), (3, long)], "doc_id long, text string")
    byte = tokenizer(queries.BYTE_BPE).encode(long, add_special_tokens=False).ids
    got = {r.doc_id: r for r in token_counts.token_counts(df, queries.BYTE_BPE).collect()}
    assert got[1].n_tokens == len(byte) == got[3].n_tokens and got[1].n_bytes == len(long) and got[2].n_tokens == 0
    out = shared_dir(spark)
    token_store.write_tokens(df, queries.BYTE_BPE, out)
    assert {r.doc_id: r.n_tokens for r in token_store.read_tokens(spark, out).collect()} == {1: len(byte) + 1, 2: 1, 3: len(byte) + 1}
    word = len(tokenizer(queries.WORD_BPE).encode(long, add_special_tokens=False).ids) + 1
    pieces = packing.pack(df, queries.WORD_BPE).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == word and all(r.doc_tokens == word for r in pieces if r.doc_id != 2)
    print_ = {r.doc_id: r.fp for r in simhash.fingerprints(df).collect()}
    assert print_[1] == print_[3] and print_[1] % (1 << 64) == simhash.fingerprint(long)
    sizes = {r.doc_id: r["size"] for r in mixing.taken(df.withColumn("source", F.lit("s"))).collect()}
    assert sizes == {1: len(long.split()), 2: 0, 3: len(long.split())}
    ends = spark.createDataFrame([(1, long + " mail x@y.org")], "doc_id long, text string")
    assert [(s.kind, s.start) for s in pii.spans(ends).collect()[0].base] == [("email", len(long) + 6)]
    sets = {r.doc_id: r["size"] for r in near.marked(df).collect()}
    assert sets[1] == len(near.shingles(near.normal(long))) and sets[2] == 0


def test_long_turns_of_a_conversation(spark, long):
    turns = [(1, 0, "user", long), (1, 1, "assistant", "a " + long), (1, 2, "user", "more"), (1, 3, "assistant", long)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    (pair,) = chat.preferences(chat.last_answers(df)).collect()
    assert long in str(pair)
