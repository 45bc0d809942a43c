"""Content-addressed web archives.

A WARC record is a header and a payload. Payloads are stored once each under the SHA-256
of their bytes; the exact headers are a table of their own. Records are put together
again by joining the two, and what is read is checked against both of its digests.

Files are Parquet tables under one folder, as executors reach a shared store through Spark
only: `headers` (row, address, header) and `payloads` (address, payload).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arkose.llm.common import forget, parted, settled

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
_LINE, _END = "\r\n", "\r\n\r\n"
# Fixed values of the format.
_RESPONSE = "application/http; msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _staged(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """The written table (row, id, url, payload, address, sha1, bytes): numbers of rows are
    fixed with it, so all later steps agree on them whatever is run again."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    return settled(rows.withColumns({"address": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")}), "zstd")


def _name(id_: Column, row: Column) -> Column:
    """A record's name; ids of any type come back from it."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A line of a header, left out for null; line ends in a value are escaped."""
    plain = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit(_LINE)), F.lit(""))


def _header() -> Column:
    """All of a record before its payload: the WARC header and the HTTP header."""
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(_END))
    revisit, block = F.col("keeper").isNotNull(), F.octet_length(http) + F.when(F.col("keeper").isNull(), F.col("bytes")).otherwise(0)
    lines = [
        F.lit(f"WARC/1.1{_LINE}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("id"), F.col("row"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _name(F.col("keeper_id"), F.col("keeper")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit(_RESPONSE)),
        _line("Content-Length", block.cast("string")),
        F.lit(_LINE),
    ]
    return F.concat(*lines, http).cast("binary")


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Writes a record for each row of `df` into the archive `path`.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is a
    response, the others revisit it; rows of fewer bytes are responses. Of repeated ids
    any one row is the response; a null id is smaller than all others. A null payload is
    an empty one; a null address of the page is left out. An empty table makes an empty
    archive. Other columns are ignored.

    Only digests and row numbers are shuffled, and the payloads of rows that a filter takes
    for copies. A payload of very many rows is one row after a partial step; the rows meet
    it in a join of two written tables, which Spark can split.
    """
    staged = _staged(df, id_col, url_col, payload_col)
    facts = staged.drop("payload")
    last = facts.groupBy("address").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("last")).where("n > 1")
    shared = settled(last.select(F.col("address").alias("of"), F.col("last.id").alias("keeper_id"), F.col("last.row").alias("keeper")))
    known = facts.join(shared, F.col("address") == F.col("of"), "left").withColumn("copy", F.coalesce(F.col("row") != F.col("keeper"), F.lit(False)))
    revisit = F.col("copy") & (F.col("bytes") >= least)
    known = known.withColumns({c: F.when(revisit, F.col(c)) for c in ("keeper", "keeper_id")})
    heads = known.select("row", "address", _header().alias("header"), "copy")
    heads.write.option("compression", "zstd").parquet(f"{path}/headers")
    copies = df.sparkSession.read.schema(heads.schema).parquet(f"{path}/headers").where("copy").select("row")
    maybe, sure = parted(staged, F.col("row"), copies)
    once = sure.union(maybe.join(copies, "row", "left_anti").select(*sure.columns))
    once.select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    forget(staged, shared)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive as they were written: row, record (its bytes), and the
    facts of its full payload, whether the record holds it or revisits it: payload,
    payload_bytes, payload_digest (SHA-1). A payload that does not have the digest
    under which it is stored is an error."""
    heads = spark.read.schema("row long, address binary, header binary").parquet(f"{path}/headers")
    bodies = spark.read.schema("address binary, payload binary").parquet(f"{path}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("address")
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")).cast("binary"))
    bodies = bodies.select(F.col("address").alias("of"), checked.alias("payload"))
    bodies = bodies.select("of", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    inside = F.col("header").cast("string").contains(f"{_LINE}WARC-Type: response{_LINE}")
    body = F.when(inside, F.col("payload")).otherwise(F.lit("").cast("binary"))
    record = F.concat(F.col("header"), body, F.lit(_END).cast("binary"))
    return heads.join(bodies, F.col("address") == F.col("of")).select("row", record.alias("record"), "payload", "payload_bytes", "payload_digest")


def parsed(df: DataFrame, column: str = "record") -> DataFrame:
    """The other columns of `df`, and of the WARC record in `column`: record_type,
    record_id, target_uri, refers_to, digest (as written), body (of the HTTP message in it).
    What a record does not have is null."""
    text = lambda c: c.cast("string")
    cut = lambda c: F.octet_length(F.substring_index(text(c), _END, 1)) + len(_END)
    field = lambda name: F.nullif(F.regexp_extract("__head", f"(?im)^{name}: ([^\r\n]*)", 1), F.lit(""))
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    rows = df.select(*others, F.col(column).alias("__record"), F.substring_index(text(F.col(column)), _END, 1).alias("__head"))
    size = field("Content-Length").cast("int")
    rows = rows.select(*others, "__head", F.substring("__record", F.octet_length("__head") + len(_END) + 1, size).alias("__block"))
    named = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "digest": "WARC-Payload-Digest"}
    body = F.substring("__block", cut(F.col("__block")) + 1, F.octet_length("__block"))
    return rows.select(*others, *[field(v).alias(k) for k, v in named.items()], body.alias("body"))


def page_of(name: Column) -> Column:
    """The id in a record's name; null for an empty one."""
    return F.url_decode(F.nullif(F.regexp_extract(name, "^<urn:x-page:([^:>]*):", 1), F.lit("")))


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per record of an archive, from its bytes: page_id, payload_bytes, payload_digest (both
    of the full payload), record_type, refers_to (of a revisit, the page of the
    response). A record whose own digest is not that of its payload is an error."""
    found = parsed(records(spark, path).drop("payload"))
    own = F.when(F.col("record_type") == "response", F.sha1("body")).otherwise(F.col("payload_digest"))
    right = (F.col("digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (own == F.col("payload_digest"))
    sure = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not have its payload's digest")).cast("string"))
    return found.select(page_of(F.col("record_id")).cast(id_type).alias("page_id"), "payload_bytes", sure.alias("payload_digest"), "record_type", page_of(F.col("refers_to")).cast(id_type).alias("refers_to"))


ORACLE = f"""
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN copy THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN copy THEN last END AS refers_to
FROM (SELECT *, strlen(h) >= {LEAST} AND page_id < last AS copy FROM (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS last FROM pages))
"""
