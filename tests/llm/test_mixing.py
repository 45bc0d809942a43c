import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arkose.llm import mixing


def fill(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        rest = total - sum(done.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3 * sizes[s] for s in over}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, copies string")


def docs():
    rows = [(i, "w " * (1 + i % 40), "hot") for i in range(400)] + [(1000 + i, "w\tx y z", f"s{i % 5}") for i in range(100)]
    return rows + [(2000 + i, "a b", "tiny") for i in range(2)] + [(3000, None, "empty"), (3001, "", "empty"), (None, "q r s", None), (None, "t", None), (7, "w " * 8, "hot"), (4000, "é f", "é"), (4001, "Z", "Z")]


def test_targets_equal_resharing(spark):
    sizes = defaultdict(int)
    for _, text, source in docs():
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    want = fill(sizes)
    rows = mixing.taken(frame(spark, docs()).withColumn("of", F.lit("x"))).collect()
    assert len(rows) == len(docs())
    of = {d: s for d, _, s in docs()}
    for r in rows:
        source = of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        rate = want[source] / sizes[source] if sizes[source] else 0
        assert int(rate + 1e-9) <= r.copies <= min(3, int(rate) + 1)
    taken = sum(r.copies * r["size"] for r in rows if r.source_size == sizes["hot"])
    assert taken == pytest.approx(want["hot"], rel=0.02)


def plain_draw(id_, turn):
    text = ":".join(str(x) for x in ("mix", turn, id_) if x is not None)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13


def test_copies_are_the_draws_of_the_best_seed(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)] + [(None, "x y", "a"), (3, "z", "a")]
    got = mixing.taken(frame(spark, rows)).collect()
    words = [len(t.split()) for _, t, _ in rows]
    sizes = {s: sum(n for n, r in zip(words, rows) if r[2] == s) for s in "ab"}
    want, copies = fill(sizes), defaultdict(list)
    for s in "ab":
        rate = want[s] / sizes[s]
        draws = [[int(rate) + (plain_draw(r[0], k) < rate - int(rate)) for r in rows if r[2] == s] for k in range(mixing.SEEDS)]
        mine = [n for n, r in zip(words, rows) if r[2] == s]
        best = min(range(mixing.SEEDS), key=lambda k: (abs(sum(c * n for c, n in zip(draws[k], mine)) - want[s]), k))
        copies[s] = sorted(zip((str(r[0]) for r in rows if r[2] == s), mine, draws[best]))
    for s in "ab":
        assert sorted((str(r.doc_id), r["size"], r.copies) for r in got if r.source_size == sizes[s]) == copies[s]


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i * i % 90), f"s{i % 12}") for i in range(600)]
    total = defaultdict(lambda: [0, 0.0])
    for r in mixing.taken(frame(spark, rows)).collect():
        total[r.doc_id % 12][0] += r.copies * r["size"]
        total[r.doc_id % 12][1] = r.target
    assert all(abs(n - want) <= 0.05 * want for n, want in total.values())


def test_reruns_agree_and_rows_repeat(spark):
    df = frame(spark, docs())
    key = lambda r: (str(r.doc_id), str(r.text))
    a, b = sorted(map(key, mixing.mix(df).collect())), sorted(map(key, mixing.mix(df.repartition(5)).collect()))
    assert a == b and mixing.mix(df).columns == df.columns
    want = sum(r.copies for r in mixing.taken(df).collect())
    assert len(a) == want


def test_empty_wordless_and_clashing_names(spark):
    assert mixing.taken(frame(spark, [])).collect() == [] and mixing.mix(frame(spark, [])).collect() == []
    rows = mixing.taken(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.target, r.copies) for r in rows] == [(0.0, 0), (0.0, 0)]
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4)], ["doc_id", "text", "source", "a.b", "rate", "row", "id"])
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == 1


def test_plan_is_native_and_has_no_single_task(spark):
    plan = mixing.mix(frame(spark, docs()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "SinglePartition"))
