import math
import random

import pytest
from pyspark.sql import functions as F

from arkose.llm import vector_search


def brute_force(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 50:
            continue
        best = {}
        for i, b in good:
            if i != q:
                s = sum(x * y for x, y in zip(a, b))
                best[i] = max(s, best.get(i, s))
        for _, b in [(i, v) for i, v in good if i == q and v != a]:
            for i, c in good:
                if i != q:
                    best[i] = max(best[i], sum(x * y for x, y in zip(b, c)))
        for rank, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k], 1):
            out.add((q, rank, i, s))
    return out


def search(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, id int, cell string")
    got = [tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("blocks", [(32768, 8192, 512), (3, 40, 2)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(vector_search, "DATA_BLOCK", blocks[1])
    monkeypatch.setattr(vector_search, "LEAST_QUERIES", blocks[2])
    rng = random.Random(2)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # a large group of ties
    rows += [(-50, [0.0] * 6), (7000, None), (7050, [1.0, None] * 3), (7100, [math.inf] * 6), (7150, [math.nan] * 6), (None, [1.0] * 6), (7200, [9.0]), (7, rows[7][1]), (100, rows[100][1])]
    rng.shuffle(rows)
    assert search(spark, rows) == brute_force(rows)


def test_few_rows(spark):
    assert search(spark, []) == set()
    assert search(spark, [(0, [1.0, 2.0])]) == set()
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == set()
    rows = [(0, [1.0, -0.001]), (1, [2.0, 0.0]), (50, [0.1, 0.1])]
    assert search(spark, rows) == brute_force(rows)


def test_large_numbers_are_exact(spark):
    rows = [(0, [1e7, 3.3]), (1, [1e7, 1.7]), (2, [1e7 + 1 / 256, -1.7]), (3, [1e300, 1.0])]
    assert search(spark, rows) == brute_force(rows[:3])
