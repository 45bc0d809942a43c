"""The registered queries on the smallest tables, and the pipeline against its parts."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from arkose.llm import pii, queries, simhash
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_equal(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op11_whitening"}))
def test_query_has_a_row_for_each_document(spark, name):
    rows = queries.QUERIES[name](spark, SF).select("doc_id").collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == ids and (name == "op2_packing" or len(rows) == len(ids))


def test_whitening_of_the_embeddings(spark):
    vectors = {r.vec_id: np.floor(64 * np.array(r.embedding, float)) + 1_000_000 for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    fit = np.unique(np.array(list(vectors.values())), axis=0)
    values = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    rows = queries.QUERIES["op11_whitening"](spark, SF).collect()
    assert len(rows) == 16 * len(vectors) and all(r.n == len(fit) and r.identity_error < 1e-8 for r in rows)
    white = {(r.vec_id, r.component): r for r in rows}
    n, sums = len(fit), fit.sum(0).astype(int)
    for (i, c), r in white.items():
        assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
        assert c > 1 or r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(vectors[i], sums))
    of = {tuple(x): i for i, x in vectors.items()}
    table = np.array([[white[of[tuple(x)], c].whitened for c in range(1, 17)] for x in fit])
    assert np.abs(np.cov(table.T, bias=True) - np.eye(16)).max() < 1e-7


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = docs.collect()
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r.doc_id for r in after}
            wrong = sum((d in kept) != bool(q) for d, q in labels.items())
            assert wrong <= 0.05 * len(labels)
        elif name == "SimHash near-dedup":
            fps = [simhash.fingerprint(r.text) for r in after]
            assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(fps) for b in fps[:i])
            assert {r.doc_id for r in after} <= {r.doc_id for r in rows}
        elif name == "PII":
            assert len(after) == len(rows)
            assert not any(pii.base_spans(r.text) for r in after) and all(r.n_chars == len(r.text) for r in after)
            assert all(r.text == before[r.doc_id].text for r in after if "<" not in r.text)
        else:
            assert max(Counter(r.doc_id for r in after).values()) <= 3 and {r.doc_id for r in after} <= {r.doc_id for r in rows}
        rows = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter({d: n for d, n in Counter(r.doc_id for r in rows).items()}).keys() == {r.doc_id for r in pieces}
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(whole[r.doc_id] for r in rows)
