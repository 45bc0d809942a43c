"""MinHash, shared runs, exact quantiles and mergeable aggregates against plain versions."""

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkose.functions.udfs import Aggregate, GeometricMean, aggregated
from arkose.operators import filters, minhash, quantiles, text


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def classes(rows, linked):
    """The least id that links reach, by texts."""
    texts = sorted({" ".join((t or "").lower().split()) for _, t in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in linked(texts):
        root[find(b)] = find(a)
    least = defaultdict(list)
    for i, t in rows:
        least[find(" ".join((t or "").lower().split()))].append(i)
    return Counter((i, min((x for x in least[find(" ".join((t or "").lower().split()))] if x is not None), default=None)) for i, t in rows)


def all_pairs(texts, similar=0.8):
    sets = [(t, shingles(t)) for t in texts if t]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 0.75 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) / len(x | y) >= similar:
                yield a, b


def near_copies():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate([None, "", " \n", "one", "one", "One ", "a b c d", "a b c d e", "hot " * 20_000])]
    return rows + [(3, rows[0][1]), (None, "no id at all in this row"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "node", "a.b", "class_id", "w")})


def test_minhash_finds_what_all_pairs_find(spark):
    rows = near_copies()
    got = minhash.near_duplicates(frame(spark, rows).repartition(5), bands=26, in_band=3)  # misses one in 10^8
    assert got.columns == ["doc_id", "class_id"]
    assert Counter(map(tuple, got.collect())) == classes(rows, all_pairs)


def test_minhash_recall_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    pairs = list(all_pairs(sorted({" ".join((t or "").lower().split()) for _, t in rows})))
    got = dict(map(tuple, minhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()))
    of = {" ".join((t or "").lower().split()): got[i] for i, t in rows}
    found = sum(of[a] == of[b] for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    together = defaultdict(set)
    for a, b in pairs:
        together[of[a]] |= {a, b}
    assert all(len(texts) == 1 or len(together[c]) >= len(texts) for c, texts in _by_class(of).items())


def _by_class(of):
    out = defaultdict(set)
    for t, c in of.items():
        if t:
            out[c].add(t)
    return out


def test_minhash_group_of_many_makes_no_pairs(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: i % 290] + [f"x{i}"] + base[i % 290 + 1 :])) for i in range(400)]
    signed = minhash.signatures(frame(spark, rows), "doc_id", "text")
    members = minhash.buckets(signed)
    assert members.count() <= 400 * minhash.BANDS
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 400 and {r.class_id for r in got} == {0}


def test_minhash_chain_of_links_is_one_class(spark):
    """Texts that are not like their bucket's leader, but like another text of it."""
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[4 * k : 4 * k + 60])) for k in range(16)]
    assert Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), threshold=0.86, bands=60, in_band=2).collect())) == classes(rows, lambda t: all_pairs(t, 0.86))


def test_minhash_of_no_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_permutations_are_fixed_and_different():
    p = minhash.permutations(78)
    assert len(set(p)) == 78 and all(0 < a < (1 << 31) - 1 and 0 <= b < (1 << 31) - 1 for a, b in p) and p[:2] == minhash.permutations(2)


def test_member_test_never_loses_one(spark):
    hashes = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    test = filters.member_test(hashes)
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    kept = {r.id for r in rows.where(test(F.col("h"))).collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 800
    none = filters.member_test(hashes.limit(0))
    assert rows.where(none(F.col("h"))).count() == 0 and rows.select(F.lit(None).cast("long").alias("h")).where(test(F.col("h"))).count() == 0


def test_filter_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_BITS", 6)
    hashes = spark.range(40).select(F.xxhash64("id").alias("h"))
    test = filters.member_test(hashes)
    assert hashes.where(test(F.col("h"))).count() == 40


def test_shared_runs_equal_a_plain_version(spark):
    line = [f"w{i % 9}" for i in range(30)]
    docs = [(1, " ".join(line)), (2, "x " + " ".join(line[:10]).upper()), (3, None), (4, ""), (5, "w0 w1"), (6, "common " * 50), (7, " ".join(line)), (None, " ".join(line[3:14]))]
    items = [(1, " ".join(line[:12])), (2, "common " * 9), (3, None), (4, "never seen words that stand in no text at all")]
    grams = lambda t: shingles(t, 8) if len((t or "").split()) >= 8 else set()
    want = Counter({(d, i, len(grams(a) & grams(b))) for d, a in docs for i, b in items if grams(a) & grams(b)})
    both = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    assert Counter(map(tuple, text.shared_runs(*both, "doc_id", "item_id").collect())) == want
    assert text.shared_runs(both[0].limit(0), both[1], "doc_id", "item_id").count() == 0 == text.shared_runs(both[0], both[1].limit(0), "doc_id", "item_id").count()


def test_equal_hashes_of_other_words_count_for_nothing(spark, monkeypatch):
    monkeypatch.setattr(text.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = spark.createDataFrame([(1, " ".join("abcdefgh")), (2, " ".join("ijklmnop"))], "doc_id long, text string")
    got = text.shared_runs(rows, rows.withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 2, 1)]


def test_only_matching_runs_leave_the_scan(spark):
    from arkose.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = text.shared_runs(t.documents, t.benchmark, "doc_id", "item_id")._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("Generate inline")[0]
    assert "Filter" in scans and "getbit" in scans


def values_of(g):
    rng = random.Random(str(g))
    return {"ties": [2.0] * 500 + [1.0, 3.0], "one": [7.0], "two": [1.0, 2.0], "wide": [rng.lognormvariate(0, 30) * rng.choice([-1, 1]) for _ in range(3000)], "plain": [rng.random() for _ in range(2000)], None: [float(i) for i in range(101)]}[g]


@pytest.mark.parametrize("few", [1, 20, 100_000])
def test_quantiles_equal_numpys(spark, few):
    groups = ["ties", "one", "two", "wide", "plain", None]
    rows = [(g, v, "x") for g in groups for v in values_of(g)] + [("none", None, "x"), ("plain", None, "x"), ("two", float("nan"), "x")]
    df = spark.createDataFrame(rows, "k string, value double, g string").repartition(4)
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "value", {"a": 0.0, "m": 0.5, "p90": 0.9, "z": 1.0}, few).collect()}
    assert set(got) == {*groups, "none"} and got["none"].m is None
    for g in groups:
        v = values_of(g)
        for name, share in (("a", 0), ("m", 0.5), ("p90", 0.9), ("z", 1)):
            assert got[g][name] == pytest.approx(float(np.quantile(v, share)), rel=1e-12, abs=1e-12), (g, name)
        assert got[g].m == pytest.approx(statistics.median(v))


def test_quantiles_of_no_rows_and_more_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "a", 3.0)], "k int, j string, v double")
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []
    got = quantiles.exact_quantiles(df, ["k", "j"], "v", {"m": 0.5}).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 2.0), (1, "b", 2.0)]


class Longest(Aggregate):
    state, result = "text string, n long", "longest string, rows long"

    def fold(self, values):
        return max(values, key=lambda s: (len(s), s)), len(values)

    def merge(self, a, b):
        return max(a[0], b[0], key=lambda s: (len(s), s)), a[1] + b[1]


def test_states_are_merged(spark):
    rows = [(i % 3 if i % 7 else None, "x" * (i % 11) + str(i)) for i in range(500)] + [(9, None)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(6)
    want = defaultdict(list)
    for k, s in rows:
        if s is not None:
            want[k].append(s)
    for most in (1, 100):
        got = {r.k: (r.longest, r.rows) for r in aggregated(df, "k", "s", Longest(), most).collect()}
        assert got == {k: (max(v, key=lambda s: (len(s), s)), len(v)) for k, v in want.items()}
    assert aggregated(df.limit(0), "k", "s", Longest()).collect() == []


def test_no_group_meets_in_a_worker(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    plan = aggregated(df, "k", "v", GeometricMean())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and not any(x in plan for x in ("AggregateInPandas", "ArrowAggregate", "FlatMapGroups", "AggregateInArrow"))
