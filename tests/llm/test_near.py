import random

import corpus_pipeline
import numpy as np
import pytest

from arkose.llm import near


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def plain_components(rows):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and plain_similar(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root, sets


def noisy(seed, groups=6, copies=12):
    """Copies with no to many changed words, so that pairs lie on both sides of 0.8."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    line = rng.choices(words, k=12)
    texts = [None, "", " \n", "One two", "one TWO", "a b a b a b a b", "a b a b a b a b a b"]
    for _ in range(groups):
        text = rng.choices(words, k=rng.choice([6, 30, 120, 300])) + line
        for _ in range(copies):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[: rng.choice([len(copy), len(copy) - 3])]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, block_rows, hot_rows, small", [(1, 3, 6, 4), (2, 1024, 1 << 20, 8)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, block_rows, hot_rows, small):
    """In small groups, in blocks of large ones, and with hot shingles."""
    monkeypatch.setattr(near, "NEXT", small)
    monkeypatch.setattr(near, "FLUSH_ROWS", 100)
    rows = noisy(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs, classes = near.classes(df, block_rows=block_rows, hot_rows=hot_rows)
    got = {r.id: r.component_id for r in docs.join(classes, "fp").collect()}
    root, _ = plain_components(rows)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert got == {i: least[r] for i, r in enumerate(root)}
    assert 12 < len(least) < len(rows) - 12


def test_bounds_drop_no_similar_pair():
    sets = [near.shingles(near.normal(t)) for _, t in noisy(3) if plain_set(t)]
    common, counts = np.unique(np.concatenate(sets), return_counts=True)
    common, counts = common[counts > 20], counts[counts > 20]
    first = [near.prefix(s, common, counts)[0].tolist() for s in sets]
    marks = [near.sketch(s) for s in sets]
    n = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if near.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                both = set(first[i]) & set(first[j])
                assert both
                one = lambda x: np.array([x])
                assert all(near.placed(one(len(a)), one(first[i].index(h)), one(len(b)), one(first[j].index(h)))[0] for h in both)
                assert near.close(one(len(a)), [marks[i]], one(len(b)), [marks[j]])[0]
                n += 1
    assert n > 60


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for n, m in ((3, 3), (64, 65), (100, 130), (5000, 4200), (0, 1), (1, 0)):
        pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, k, replace=False)) for k in (n, m))
        assert near.distances([near.sketch(a)], [near.sketch(b)])[0] <= len(np.setxor1d(a, b))
        assert near.distances([near.sketch(a)], [near.sketch(a)])[0] == 0


def test_rows_of_blocks_come_back():
    h, fp = np.array([7, 1 << 31, (1 << 32) - 1]), np.array([-5, 0, 1 << 62])
    pos, size = np.array([0, 70_000, 3]), np.array([1, 1 << 20, 9])
    for bucket, key in ((3, h | 3 << 32), (-2, h | 9 << 32)):
        back = near._rows(bucket, near._planes(bucket, key, fp, pos, size))
        assert [x.tolist() for x in back] == [key.tolist(), fp.tolist(), pos.tolist(), size.tolist()]


def test_pipeline_stage_leaves_no_similar_pair(spark):
    rows = [(i, t, "en", "s", 1) for i, t in noisy(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    root, sets = plain_components([r[:2] for r in rows])
    assert not any(plain_similar(sets[i], sets[j]) for i in kept for j in kept if i < j)
    assert kept == sorted({r: i for i, r in reversed(list(enumerate(root)))}.values())
