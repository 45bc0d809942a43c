"""The SimHash turn of near-dedup, and pairs listed at the first shingle of both sets."""

import corpus_pipeline
import numpy as np

from arkose.llm import near, simhash
from tests.llm.test_near import noisy, plain_set


def bits_of(text):
    return simhash.voted(near.shingles(near.normal(text)))


def apart(a, b):
    return bin(a ^ b).count("1")


def test_simhash_is_the_majority_of_the_hashes():
    for _, text in noisy(5):
        hashes = [int(h) for h in near.shingles(near.normal(text))]
        assert bits_of(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_each_set_with_a_simhash_within_4_bits_is_in_a_pair(spark):
    rows = noisy(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = near.marked(df).select("fp", "bits").distinct()
    bits = {r.fp: r.bits % (1 << 64) for r in fps.collect()}
    pairs = {(r.u, r.v) for r in near.simhash_pairs(fps).collect()}
    assert all(u < v and apart(bits[u], bits[v]) <= 4 for u, v in pairs)
    close = {f for f in bits for g in bits if f != g and apart(bits[f], bits[g]) <= 4}
    assert {f for p in pairs for f in p} == close and len(close) > 12


def test_the_stage_takes_candidates_from_simhash(spark, monkeypatch):
    """One word in the middle of 240 differs: within 4 bits here, and 0.96 of Jaccard."""
    words = [f"w{i}" for i in range(240)]
    a = next(" ".join(words[:120] + [f"x{k}"] + words[121:]) for k in range(999) if apart(bits_of(" ".join(words)), bits_of(" ".join(words[:120] + [f"x{k}"] + words[121:]))) <= 4)
    found = []
    pairs = near.simhash_pairs
    monkeypatch.setattr(near, "simhash_pairs", lambda *args: found.append(pairs(*args)) or found[-1])
    monkeypatch.setattr(near, "forget", lambda *tables: None)
    df = spark.createDataFrame([(1, " ".join(words), "p"), (2, a, "q"), (3, "other words", "r")], "doc_id long, text string, source string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept == [1, 3]
    assert [{r.u, r.v} for r in found[0].collect()] == [{near.node(near.shingles(near.normal(t))) for t in (" ".join(words), a)}]


def test_similar_pairs_pass_at_the_first_shingle_of_both():
    sets = [near.shingles(near.normal(t)) for _, t in noisy(3) if plain_set(t)]
    common, counts = np.unique(np.concatenate(sets), return_counts=True)
    common, counts = common[counts > 20], counts[counts > 20]
    first = [near.prefix(s, common, counts)[0].tolist() for s in sets]
    one = lambda x: np.array([x])
    n = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if near.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                x, y = min((first[i].index(h), first[j].index(h)) for h in set(first[i]) & set(first[j]))
                assert near.placed(one(len(a)), one(x), one(len(b)), one(y), True)[0]
                n += 1
    assert n > 60


def test_a_late_shingle_lists_no_pair():
    """Of two sets of 100, 89 must be common, so one of the first 12 of each is."""
    size, pos = np.full(20, 100), np.arange(20)
    assert near.placed(size, pos, size, pos).all()
    assert near.placed(size, pos, size, pos, True).tolist() == [p <= 11 for p in range(20)]
