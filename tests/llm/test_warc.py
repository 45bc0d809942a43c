"""Archives: records come back byte by byte, payloads are kept once, odd rows."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arkose.llm import common, warc


def rows():
    big = "<p>ü" + "x" * 1200
    out = [(i, f"http://a.example/{i}", big if i % 3 == 0 else f"{big}{i}") for i in range(60)]
    out += [(100 + i, None, "small") for i in range(5)] + [(200, "http://b\r\nX: y", None), (201, "", ""), (202, "u", "\r\n\r\nWARC-Type: response\r\n\r\n" * 60)]
    out += [(300, "twice", "t" * 999 + "ü")] * 3 + [(None, "no id", "n" * 2000)] * 2 + [(301, "least", "l" * 1000), (302, "least", "l" * 1000), (303, "less", "l" * 999), (304, "less", "l" * 999)]
    return out + [(400, "long", "word " * 400_000), (-5, "long", "word " * 400_000)]


def frame(spark, found):
    return spark.createDataFrame(found, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("row", "address", "payload", "a.b", "keeper")})


def written(df, spark):
    path = common.shared_dir(spark)
    warc.write_archive(df, path)
    return path


def plain(found):
    groups = defaultdict(list)
    for i, (page, _, html) in enumerate(found):
        groups[(html or "").encode()].append((page is not None, page or 0, i))
    out = []
    for body, members in groups.items():
        best = max(members)
        for has, page, i in members:
            copy = len(body) >= 1000 and i != best[2]
            out.append((page if has else None, len(body), hashlib.sha1(body).hexdigest(), "revisit" if copy else "response", best[1] if copy and best[0] else None))
    return Counter(out)


def test_equals_a_plain_version(spark):
    for df in (frame(spark, rows()), frame(spark, rows()).repartition(6)):
        got = warc.read_archive(spark, written(df, spark))
        assert Counter(map(tuple, got.collect())) == plain(rows())
        assert got.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]


def test_payloads_are_stored_once(spark):
    path = written(frame(spark, rows()), spark)
    bodies = [bytes(r.payload) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(bodies) == sorted({(h or "").encode() for _, _, h in rows()})


def read_warc(data):
    """One record by the format's rules: its fields, its HTTP body, nothing after it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    assert first == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    assert end == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
    return fields, block.partition(b"\r\n\r\n")[2]


def test_records_are_well_formed(spark):
    path = written(frame(spark, rows()), spark)
    names, seen = {}, []
    for r in warc.records(spark, path).collect():
        fields, body = read_warc(bytes(r.record))
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
        assert body == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")
        names[fields["WARC-Record-ID"]] = fields
        seen.append(fields)
    assert len(names) == len(rows())
    for f in seen:
        if f["WARC-Type"] == "revisit":
            answer = names[f["WARC-Refers-To"]]
            assert answer["WARC-Type"] == "response" and answer["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
    assert Counter(f.get("WARC-Target-URI") for f in seen)["http://b%0D%0AX: y"] == 1


def test_a_changed_payload_is_an_error(spark):
    path = written(frame(spark, rows()), spark)
    bodies = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    bad = common.shared_dir(spark)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    bodies.write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, bad).collect()


def test_empty_table_and_text_ids(spark):
    assert warc.read_archive(spark, written(frame(spark, []), spark)).collect() == []
    named = spark.createDataFrame([("a:b>", "u", "z" * 1500), ("ü c", "u", "z" * 1500)], "page_id string, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_archive(spark, written(named, spark), "string").collect()}
    assert got == {"a:b>": "ü c", "ü c": None}


def test_hot_payloads_meet_written_tables(spark):
    """Both inputs of each join are scans, so Spark can split a hot payload's rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.records(spark, written(frame(spark, rows()), spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan and "Window" not in plan
