"""Importance resampling against a plain version, on odd rows, and by its plan."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from arkose.llm import resampling

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def rows():
    out = [(i, " ".join(LINE.split()[(i * k) % 10] for k in range(i % 60)), "x") for i in range(1, 120)]
    out += [(200, None, "x"), (201, "", "x"), (202, " \t--- ", "x"), (203, "Ünï ÇÖDE 9x_9 日本 a-b " * 30, "x"), (204, "hot " * 30_000, "x")]
    return out + [(205, LINE * 4, "x")] * 3 + [(None, LINE * 3, None), (None, None, None)]


def frame(spark, found):
    return spark.createDataFrame(found, "doc_id long, text string, `a.b` string").withColumns({"row": F.lit(1), "n": F.lit("n"), "id": F.lit("i"), "bucket": F.lit(0), "rank": F.lit("r")})


def plain_words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(found, target):
    s, t = (Counter(b for text in texts for b in plain_buckets(text)) for texts in ([r[1] for r in found], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text, *_ in found:
        hits = plain_buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in hits)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(hits), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * 5 // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df, target):
    out = resampling.ranked(df, target)
    assert out.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_features", "weight", "score", "rank")]]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_a_plain_version(spark):
    target = [LINE, "alpha gamma alpha", None, "日本 ünï"]
    found = rows()
    want = plain(found, target)
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(frame(spark, found), texts) == want == got(frame(spark, found).repartition(5), texts)
    assert sum(r[4] is not None for r in want) >= 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert got(frame(spark, []), none) == []
    assert got(frame(spark, rows()), none) == plain(rows(), [])


def test_a_third_of_all_rows_alike(spark):
    found = [(i, LINE * 2 if i % 3 else f"{LINE} {i} " * 2) for i in range(300)]
    target = spark.createDataFrame([(LINE,)], "text string")
    df = spark.createDataFrame(found, "doc_id long, text string")
    assert got(df, target) == plain(found, [LINE])


def test_drawn_rows_keep_their_columns(spark):
    target = spark.createDataFrame([(LINE,)], "text string")
    df = frame(spark, [r for r in rows() if r[0] is not None])
    drawn = resampling.resampled(df, target)
    ids = {r.doc_id for r in resampling.ranked(df, target).where("rank IS NOT NULL").collect()}
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == ids
    assert {(r.doc_id, r.text) for r in drawn.collect()} <= {(r.doc_id, r.text) for r in df.collect()}


def test_plan_is_native(spark):
    plan = resampling.ranked(frame(spark, rows()), frame(spark, rows()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "SinglePartition", "Cartesian", "NestedLoop"))
