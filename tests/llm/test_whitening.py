"""Whitening against a plain version with exact sums, and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkose.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, `a.b` int"


def frame(spark, vectors):
    return spark.createDataFrame([(i if i % 17 else None, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def cloud(rows, dims, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(rows, dims)) @ rng.normal(size=(dims, dims)) / 4 + rng.normal(size=dims)).astype(np.float32).tolist()


def whole(vectors):
    return [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]


def plain(vectors, most):
    """Distinct whole vectors, exact covariance, numpy's eigenvectors."""
    fit = [list(v) for v in {tuple(v) for v in whole(vectors)}]
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    centred = np.array([[float(Fraction(n * v[d] - sums[d], n)) for d in range(dims)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:most], axes[:, ::-1][:, :most], float(np.trace(centred.T @ centred / n))


@pytest.mark.parametrize("dims", [3, 16, 37])
def test_equals_a_plain_version(spark, dims):
    vectors = cloud(200, dims)
    vectors += vectors[:40] + [vectors[7]] * 60
    most = min(16, dims)
    n, sums, values, axes, trace = plain(vectors, most)
    got = whitening.components(frame(spark, vectors).repartition(5)).collect()
    assert len(got) == len(vectors) * most and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    want = {}
    for i, x in enumerate(whole(vectors)):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        row = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ axes / np.sqrt(values)
        want.setdefault((i if i % 17 else None), []).append((deviation, row))
    sign = {}
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        options = [w for d, w in want[r.vec_id] if d == r.deviation]
        assert any(abs(abs(w[r.component - 1]) - abs(r.whitened)) < 1e-7 for w in options)
        if r.vec_id is not None and abs(r.whitened) > 1e-3:
            sign.setdefault(r.component, set()).add(np.sign(r.whitened * options[0][r.component - 1]))
    assert all(len(s) == 1 for s in sign.values())


def test_model_is_that_of_all_tiles(spark):
    vectors = cloud(500, 40, seed=3)
    df = frame(spark, vectors)
    one, many = whitening.train(df, width=64), whitening.train(df.repartition(7), width=7)
    assert one.n == many.n and list(one.sums) == list(many.sums)
    assert np.allclose(one.values, many.values, rtol=1e-12) and np.allclose(one.vectors, many.vectors, atol=1e-9)


def test_odd_vectors_take_no_part(spark):
    good = cloud(60, 5)
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [0.5] * 6]
    got = whitening.components(frame(spark, good + bad)).collect()
    same = whitening.components(frame(spark, good)).collect()
    value = lambda rows: sorted((str(r.vec_id), r.component, r.deviation, round(r.whitened, 6)) for r in rows)
    assert value(got) == value(same)


def test_few_flat_and_no_vectors(spark):
    assert whitening.components(frame(spark, [])).collect() == [] and whitening.components(frame(spark, [None])).collect() == []
    assert whitening.components(frame(spark, [[1.0, 2.0]] * 9)).collect() == []
    flat = whitening.components(frame(spark, [[float(i), 2.0 * i, 1.0] for i in range(1, 9)])).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def test_deviation_is_exact_where_doubles_are_not(spark):
    model = whitening.train(frame(spark, [[float(i % 7), float(i)] for i in range(1, 300)]))
    sums = np.array([10**15 + 1, 3], object)
    rows = whitening.whiten(frame(spark, [[1.0, 2.0], [1e12, 0.0]]), model._replace(sums=sums)).collect()
    for r, v in zip(sorted(rows, key=lambda r: (r.vec_id is not None, r.vec_id)), whole([[1.0, 2.0], [1e12, 0.0]])):
        exact = sum((model.n * a - s) ** 2 for a, s in zip(v, sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
    with pytest.raises(Exception, match="too large"):
        whitening.train(frame(spark, [[1e30, 0.0]]))


def test_columns_travel_in_narrow_cells(spark):
    kinds = [whitening._narrow(np.array([[lo, hi]])).dtype for lo, hi in ((-128, 127), (-129, 0), (0, 1 << 15), (0, 1 << 40))]
    assert kinds == [np.int8, np.int16, np.int32, np.int64]
    double = frame(spark, cloud(50, 4)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert whitening.components(double).count() == 200
