import math
import random
import zlib

import numpy as np

from arkose.llm import quality


def corpus(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeioulnrst", k=rng.randint(1, 8))) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        if bad:
            half = len(words) // 2
            words = words[:half] + [w.upper() + "!!" for w in words[half:]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_learns_on_rows_that_are_not_held_out(spark):
    rows, labels = corpus()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, 1 - q if i in held else q, t) for i, q, t in labels]  # their labels must not matter
    extra = [(1000, None), (1001, ""), (None, "some words"), (1002, " \n\t"), (1003, "x" * 3_000_000), (1003, "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + extra], "doc_id long, text string, score double")
    table = spark.createDataFrame(wrong + [(None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(df, quality.train(df, table)).withColumn("held", quality.held_out()).collect()
    assert len(scored) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in scored)
    truth = {i: q for i, q, _ in labels}
    right = [(r.score >= 0.7) == truth[r.doc_id] for r in scored if r.doc_id in held]
    assert np.mean(right) > 0.95
    assert {r.doc_id for r in scored if r.held} == {i for i in held} | {i for i in (1000, 1001, 1002, 1003) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(df, none)
    assert model.weights is None and {r.score for r in quality.score(df, model).collect()} == {0.5}
    assert quality.score(df.limit(0), model).collect() == []
    assert quality.accepted(df, model).count() == 2  # nothing to tell them apart by
    one_kind = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")
    assert quality.accepted(df, quality.train(df, one_kind)).count() == 2
    strangers = spark.createDataFrame([(i, i % 2) for i in range(50, 90)], "doc_id long, quality int")
    assert quality.train(df, strangers).weights is None
    assert quality.train(df.limit(0), strangers).weights is None


def test_accepted_keeps_rows_whole(spark):
    df = spark.createDataFrame([(1, "fine words", {"k": 1}), (2, None, None)], "doc_id long, text string, score map<string,int>")
    got = quality.accepted(df, quality.Model(0.9))
    assert got.schema == df.schema and got.count() == 2


def test_bags_do_not_depend_on_neighbours():
    texts = ["one two three", None, "", " a " * 500, "É " * 100, "w" * 2_500_000, "b c"]
    alone = [next(iter(quality.bags([t]))) for t in texts]
    together = list(quality.bags(texts))
    assert len(alone) == len(together)
    for a, b in zip(alone, together):
        assert a.shape == b.shape and np.allclose(a, b)


def test_repeats_and_classes_are_seen():
    x, counts = quality.passages([b"the the the the", b"ONE|TWO", b""])
    lag = quality.N_FINE + quality.N_COARSE**2
    assert counts.tolist() == [1, 1, 1] and x[0, lag] == 0.75 and x[1, lag] == 0 and not x[2].any()


def toy(n=60):
    rng = np.random.default_rng(0)
    bags = [rng.normal(0, 1, (rng.integers(1, 5), quality.N_FEATURES)).astype("<f4") for _ in range(n)]
    labels = [i % 2 for i in range(n)]
    for b, y in zip(bags, labels):
        b[0, 0] = 6 if y else -6
    return bags, labels


def plain_score(model, bag):
    """Gated attention as its formula says, one passage and one unit at a time."""
    w = model.weights
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda u, m, j: sum(float(u[i]) * float(m[i][j]) for i in range(len(u)))
    hs, gates = [], []
    for x in bag:
        x = [max(-10, min(10, (float(v) - m) / s)) for v, m, s in zip(x, w["mean"], w["std"])]
        h = [math.tanh(dot(x, w["W"], j) + w["b"][j]) for j in range(quality.HIDDEN)]
        hs.append(h)
        gates.append(sum(w["a"][j] * math.tanh(dot(h, w["V"], j)) * sig(dot(h, w["U"], j)) for j in range(quality.GATES)))
    e = [math.exp(g) for g in gates]
    z = [sum(a * h[j] for a, h in zip(e, hs)) / sum(e) for j in range(quality.HIDDEN)]
    return sig(sum(v * c for v, c in zip(z, w["c"])) + float(w["c0"]))


def test_training_parts_the_classes_and_scores_as_the_formula_says():
    bags, labels = toy()
    model = quality.fit(bags, labels)
    assert all((model.score(b) >= 0.5) == bool(y) for b, y in zip(bags, labels))
    for b in [*bags[:12], np.zeros((1, quality.N_FEATURES), "<f4"), np.concatenate(bags)]:
        assert abs(model.score(b) - plain_score(model, b)) < 1e-9


def test_gradients_equal_differences_of_the_loss():
    bags, labels = toy(7)
    rng = np.random.default_rng(3)
    w = {k: v + rng.normal(0, 0.3, v.shape) for k, v in quality.first_weights(rng, 0.6).items()}
    args = np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), np.array(labels, float), 1e-2
    loss, grads = quality.loss_and_gradients(w, *args)
    for k, v in w.items():
        for at in rng.integers(0, v.size, 6):
            ends = []
            for step in (1e-5, -1e-5):
                moved = np.array(v, float)
                moved.reshape(-1)[at] += step
                ends.append(quality.loss_and_gradients(w | {k: moved}, *args)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - np.asarray(grads[k]).reshape(-1)[at]) < 1e-6, k


def test_passages_go_on_across_pieces(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcD1.é", k=rng.randint(1, 9))) for _ in range(n)) for n in (5, 64, 65, 1000, 3000)]
    texts += ["  " + texts[3] + " \n ", "w" * 5000 + " " + texts[2], "y " * 63 + "z" * 4000 + " " + texts[3], " " * 3000, "v" * 9000]
    whole = [quality.passages([t.encode()])[0] for t in texts]
    monkeypatch.setattr(quality, "PIECE", 700)
    for one, pieces in zip(whole, quality.bags(texts)):
        assert one.shape == pieces.shape and np.allclose(one, pieces)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "fine", 2, "x")], ["doc_id", "text", "a.b", "c0"])
    model = quality.fit(*toy())
    got = quality.accepted(df, model, threshold=0.0)
    assert got.columns == df.columns and got.collect() == df.collect()


def test_fitting_sees_all_passages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.extend(map(len, x)))
    text = "some words of a long text " * 3000
    df = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    quality.train(df, labels)
    assert seen and set(seen) == {len(next(iter(quality.bags([text]))))} and seen[0] > 32
