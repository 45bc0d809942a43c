"""Scalar functions by family, each compared on whole tables."""

from __future__ import annotations

import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from arkose.registry import Registry

R = Registry()


@R.query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name)::INT AS len, substring(p_name, 2, 3) AS sub, left(p_name, 2) AS l, right(p_name, 3) AS r, trim('  ' || p_name || ' ') AS tr, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt,
  lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(p_brand, 2) AS rep, reverse(p_name) AS rev, instr(p_name, 'a')::INT AS ins, p_brand || p_type AS cat, concat_ws('/', p_brand, p_type) AS cws, replace(p_name, 'a', 'o') AS repl, translate(p_name, 'aeiou', '12345') AS tra,
  split_part(p_brand, '#', 2) AS sp, string_split(p_name, ' ') AS parts, ascii(p_type)::INT AS asc, levenshtein(p_name, p_type)::INT AS lev, starts_with(p_type, 'S') AS sw, ends_with(p_type, 'Y') AS ew, contains(p_name, 'e') AS has, chr(65 + p_size % 26) AS ch, bit_length(p_name)::INT AS bits, octet_length(p_name::BLOB)::INT AS oct FROM part""")
def h1_string(t):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select("p_partkey", F.lower(n).alias("lo"), F.upper(n).alias("up"), F.length(n).alias("len"), F.substring(n, 2, 3).alias("sub"), F.left(n, F.lit(2)).alias("l"), F.right(n, F.lit(3)).alias("r"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), F.ltrim(F.concat(F.lit("  "), n)).alias("lt"), F.rtrim(F.concat(n, F.lit("  "))).alias("rt"),
        F.lpad(b, 12, "*").alias("lp"), F.rpad(b, 12, "-").alias("rp"), F.repeat(b, 2).alias("rep"), F.reverse(n).alias("rev"), F.instr(n, "a").alias("ins"), F.concat(b, k).alias("cat"), F.concat_ws("/", b, k).alias("cws"), F.replace(n, F.lit("a"), F.lit("o")).alias("repl"), F.translate(n, "aeiou", "12345").alias("tra"),
        F.split_part(b, F.lit("#"), F.lit(2)).alias("sp"), F.split(n, " ").alias("parts"), F.ascii(k).alias("asc"), F.levenshtein(n, k).alias("lev"), F.startswith(k, F.lit("S")).alias("sw"), F.endswith(k, F.lit("Y")).alias("ew"), F.contains(n, F.lit("e")).alias("has"), F.char(65 + F.col("p_size") % 26).alias("ch"), F.bit_length(n).alias("bits"), F.octet_length(n).alias("oct"))


@R.query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'R163' ELSE 'T522' END AS sx, printf('%05d-%s', p_partkey, p_brand) AS fmt, upper(left(lower(p_type), 1)) || substring(lower(p_type), 2) AS ini, base64(p_brand::BLOB) AS b64, hex(p_brand) AS hx FROM part")
def h1_string_more(t):
    return t.part.select("p_partkey", F.soundex(F.when(F.col("p_partkey") % 2 == 0, "Robert").otherwise("Tymczak")).alias("sx"), F.format_string("%05d-%s", "p_partkey", "p_brand").alias("fmt"), F.initcap("p_type").alias("ini"), F.base64(F.col("p_brand").cast("binary")).alias("b64"), F.hex("p_brand").alias("hx"))


@R.query(r"""SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS one_space, regexp_extract(text, '(\p{L}+) (\p{L}+)', 2) AS second, len(regexp_extract_all(text, '\w+'))::INT AS words, list_slice(regexp_extract_all(text, '\p{L}+'), 1, 5) AS first_words, regexp_matches(text, '[0-9]{3}') AS digits FROM documents""")
def h2_regex(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.regexp_replace(c, r"\s+", " ").alias("one_space"), F.regexp_extract(c, r"(\p{L}+) (\p{L}+)", 2).alias("second"), F.regexp_count(c, F.lit(r"\w+")).alias("words"), F.slice(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)), 1, 5).alias("first_words"), F.regexp_like(c, F.lit("[0-9]{3}")).alias("digits"))


def murmur3(data: bytes, seed: int = 42) -> int:
    """Spark's 32-bit `hash` of a string: MurmurHash3 of its words of 4 bytes, then of each
    byte that is left, signed, as a word of its own."""
    low = (1 << 32) - 1
    turn = lambda x, n: (x << n | x >> (32 - n)) & low
    whole = len(data) // 4 * 4
    parts = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [(b - 256 if b > 127 else b) & low for b in data[whole:]]
    h = seed
    for k in parts:
        h = turn(h ^ turn(k * 0xCC9E2D51 & low, 15) * 0x1B873593 & low, 13) * 5 + 0xE6546B64 & low
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & low
    h = (h ^ h >> 13) * 0xC2B2AE35 & low
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@R.query("SELECT doc_id, md5(text) AS m, sha256(text) AS s2 FROM documents")
def h3_hash(t):
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s2"))


@R.query("SELECT doc_id, sha1(text) AS sha1, true AS crc, true AS murmur, true AS xx FROM documents")
def h3_hash_own(t):
    """Hashes that DuckDB lacks: the CRC-32 of a text is that of its bytes as zlib has it,
    xxhash64 that of the library, and murmur's value has a plain version."""
    @F.arrow_udf("boolean")
    def crc(text: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(s.encode()) == v for s, v in zip(text.to_pylist(), value.to_pylist())])

    @F.arrow_udf("boolean")
    def xx(text: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh64_intdigest(s.encode(), 42) == v % (1 << 64) for s, v in zip(text.to_pylist(), value.to_pylist())])

    @F.arrow_udf("boolean")
    def murmur(text: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array([murmur3(s.encode()) == v for s, v in zip(text.to_pylist(), value.to_pylist())])

    start = F.substring("text", 1, 64)
    return t.documents.select("doc_id", F.sha1("text").alias("sha1"), crc("text", F.crc32("text")).alias("crc"), murmur(start, F.hash(start)).alias("murmur"), xx("text", F.xxhash64("text")).alias("xx"))


@R.query("""SELECT event_id, year(ts)::INT AS y, quarter(ts)::INT AS q, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, (dayofweek(ts) + 1)::INT AS dow, dayofyear(ts)::INT AS doy, weekofyear(ts)::INT AS woy,
  date_trunc('week', ts)::TIMESTAMP AS wk, date_trunc('hour', ts)::TIMESTAMP AS hr, (ts::DATE + 3)::DATE AS plus3, (ts::DATE - DATE '2024-01-01')::INT AS since, last_day(ts::DATE) AS ld, make_date(year(ts), 1, 1) AS jan, strftime(ts, '%Y-%m') AS ym, (ts::DATE + INTERVAL 2 MONTH)::DATE AS m2, floor(epoch(ts))::BIGINT AS ep FROM events""")
def h4_datetime(t):
    ts = F.col("ts")
    day = ts.cast("date")
    return t.events.select("event_id", F.year(ts).alias("y"), F.quarter(ts).alias("q"), F.month(ts).alias("mo"), F.day(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), F.dayofweek(ts).alias("dow"), F.dayofyear(ts).alias("doy"), F.weekofyear(ts).alias("woy"),
        F.date_trunc("week", ts).cast("timestamp_ntz").alias("wk"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hr"), F.date_add(day, 3).alias("plus3"), F.datediff(day, F.lit("2024-01-01").cast("date")).alias("since"), F.last_day(day).alias("ld"), F.make_date(F.year(ts), F.lit(1), F.lit(1)).alias("jan"), F.date_format(ts, "yyyy-MM").alias("ym"), F.add_months(day, 2).alias("m2"),
        F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).alias("ep"))


@R.query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS again, datediff('day', DATE '1970-01-01', ts::DATE)::INT AS days FROM events")
def h4_unix(t):
    """Seconds of UTC from text with an offset, whatever the session's time zone."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+0000"))
    seconds = F.unix_timestamp(text, "yyyy-MM-dd HH:mm:ssZ")
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return t.events.select("event_id", seconds.alias("seconds"), F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("again"), F.unix_date(F.to_date("ts")).alias("days"))


@R.query("SELECT o_orderkey, strptime('1998-03-0' || (o_orderkey % 9 + 1), '%Y-%m-%d') AS parsed, datediff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS days_left, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS months FROM orders")
def h4_parse(t):
    text = F.concat(F.lit("1998-03-0"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd")).alias("parsed"), F.datediff(F.lit("2002-01-01").cast("date"), d.cast("date")).alias("days_left"), F.floor(F.months_between(F.trunc(d, "month"), F.lit("1989-12-01").cast("date"))).alias("months"))


@R.query("""SELECT event_id, abs(value - 50) AS ab, ceil(value)::BIGINT AS ce, floor(value)::BIGINT AS fl, sqrt(value) AS sq, sign(value - 50)::DOUBLE AS sg, least(value, 20.0) AS le, greatest(value, 80.0) AS gr, degrees(value) AS dg, ((user_id % 7 + 7) % 7)::BIGINT AS pm, round(exp(value / 100), 6) AS ex, round(ln(value + 1), 6) AS ln, round(log10(value + 1), 6) AS lg, round(sin(value), 6) AS si, round(cos(value), 6) AS co, round(atan2(value, 3), 6) AS at, round(power(value, 1.5), 6) AS pw, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value / (user_id % 5) END AS dv, (user_id & 12) AS an, (user_id | 3) AS orr, xor(user_id, 6) AS xo, (user_id << 2) AS sl FROM events""")
def h5_math(t):
    v, u = F.col("value"), F.col("user_id")
    return t.events.select("event_id", F.abs(v - 50).alias("ab"), F.ceil(v).alias("ce"), F.floor(v).alias("fl"), F.sqrt(v).alias("sq"), F.sign(v - 50).alias("sg"), F.least(v, F.lit(20.0)).alias("le"), F.greatest(v, F.lit(80.0)).alias("gr"), F.degrees(v).alias("dg"), F.pmod(u, F.lit(7)).alias("pm"), F.round(F.exp(v / 100), 6).alias("ex"), F.round(F.ln(v + 1), 6).alias("ln"), F.round(F.log10(v + 1), 6).alias("lg"), F.round(F.sin(v), 6).alias("si"), F.round(F.cos(v), 6).alias("co"), F.round(F.atan2(v, F.lit(3.0)), 6).alias("at"), F.round(F.pow(v, F.lit(1.5)), 6).alias("pw"), F.try_divide(v, u % 5).alias("dv"), u.bitwiseAND(12).alias("an"), u.bitwiseOR(3).alias("orr"), u.bitwiseXOR(6).alias("xo"), F.shiftleft(u, 2).alias("sl"))


@R.query("SELECT event_id, CASE WHEN value >= 100 THEN 11 WHEN value < 0 THEN 0 ELSE floor(value / 10) + 1 END::BIGINT AS bucket, NULL::BIGINT AS over, round_even(value / 2, 0)::BIGINT AS even, round_even(floor(value) / 2, 0)::BIGINT AS ties FROM events")
def h5_buckets(t):
    """All rows; the halves of whole numbers are ties, which go to the even side."""
    v = F.col("value")
    return t.events.select("event_id", F.width_bucket(v, F.lit(0.0), F.lit(100.0), F.lit(10)).alias("bucket"), F.try_add(F.lit(9223372036854775807), F.lit(1)).alias("over"), F.bround(v / 2).cast("bigint").alias("even"), F.bround(F.floor(v) / 2).cast("bigint").alias("ties"))


_W = "string_split(p_name, ' ')"


@R.query(f"""SELECT p_partkey, len({_W})::INT AS n, {_W}[1] AS head, list_slice({_W}, 1, 2) AS two, list_sort(list_distinct({_W})) AS uniq, list_contains({_W}, 'red') AS has, list_transform({_W}, lambda x: upper(x)) AS up, list_filter({_W}, lambda x: length(x) > 4) AS long_, coalesce(list_position({_W}, 'red'), 0)::BIGINT AS pos, flatten([{_W}, ['z']]) AS flat,
  list_sum(list_transform({_W}, lambda x: length(x)))::BIGINT AS letters, generate_series(1, p_size % 4 + 1) AS seq, list_sort(list_intersect({_W}, ['red', 'blue'])) AS both_ FROM part""")
def h6_array(t):
    w = F.split("p_name", " ")
    return t.part.select("p_partkey", F.size(w).alias("n"), F.element_at(w, 1).alias("head"), F.slice(w, 1, 2).alias("two"), F.array_sort(F.array_distinct(w)).alias("uniq"), F.array_contains(w, "red").alias("has"), F.transform(w, F.upper).alias("up"), F.filter(w, lambda x: F.length(x) > 4).alias("long_"), F.array_position(w, "red").alias("pos"), F.flatten(F.array(w, F.array(F.lit("z")))).alias("flat"), F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("letters"), F.sequence(F.lit(1).cast("bigint"), F.col("p_size") % 4 + F.lit(1).cast("bigint")).alias("seq"), F.array_sort(F.array_intersect(w, F.array(F.lit("red"), F.lit("blue")))).alias("both_"))


@R.query(f"SELECT p_partkey, list_reverse_sort({_W}) AS down, list_transform({_W}, lambda x: x || ':' || length(x)) AS zipped, len({_W})::INT AS n FROM part")
def h6_sort_zip(t):
    w = F.split("p_name", " ")
    pairs = F.arrays_zip(w.alias("word"), F.transform(w, F.length).alias("letters"))
    zipped = F.transform(pairs, lambda z: F.concat_ws(":", z["word"], z["letters"].cast("string")))
    return t.part.select("p_partkey", F.sort_array(w, asc=False).alias("down"), zipped.alias("zipped"), F.json_array_length(F.to_json(w)).alias("n"))


@R.query("SELECT p_partkey, list_sort(list_distinct([p_size, 3, 5, 3])) AS un, len(list_filter([p_size, 9], lambda x: x <> 9))::INT AS ex, len(list_filter([p_size, 20], lambda x: x > 25)) > 0 AS some_, p_size > 2 AS all_, [p_size + 1, 4] AS zipped FROM part")
def h6_array_sets(t):
    s, a = F.col("p_size"), F.array
    lit = F.lit
    return t.part.select("p_partkey", F.array_sort(F.array_union(a(s, lit(3)), a(lit(5), lit(3)))).alias("un"), F.size(F.array_except(a(s, lit(9)), a(lit(9)))).alias("ex"), F.exists(a(s, lit(20)), lambda x: x > 25).alias("some_"), F.forall(a(s, lit(20)), lambda x: x > 2).alias("all_"), F.zip_with(a(s, lit(3)), a(lit(1), lit(1)), lambda x, y: x + y).alias("zipped"))


@R.query("SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS word FROM documents) GROUP BY word".replace("\\\\", "\\"))
def h6_explode(t):
    """Distinct in each document before the explode: one shuffle of partial counts."""
    words = t.documents.select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"\s+", " "), " "))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@R.query("SELECT doc_id, pos::INT AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def h6_posexplode(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@R.query("SELECT p_partkey, p_size AS got, ['brand', 'type'] AS keys, [p_brand, p_type] AS vals, [p_brand || '!', p_type || '!'] AS bang, ['type'] AS kept, 'b' AS parsed, p_type AS field FROM part")
def h7_map_struct(t):
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")
    return t.part.select("p_partkey", F.element_at(F.create_map(F.lit("s"), "p_size"), "s").alias("got"), F.map_keys(m).alias("keys"), F.map_values(m).alias("vals"), F.map_values(F.transform_values(m, lambda k, v: F.concat(v, F.lit("!")))).alias("bang"), F.map_keys(F.map_filter(m, lambda k, v: k == "type")).alias("kept"), F.element_at(F.map_concat(F.str_to_map(F.lit("x:a,y:b"), F.lit(","), F.lit(":")), F.create_map(F.lit("z"), F.lit("c"))), "y").alias("parsed"), F.named_struct(F.lit("t"), "p_type")["t"].alias("field"))


@R.query("SELECT p_partkey, ['brand=' || p_brand, 'type=' || p_type] AS entries, p_type AS back, p_brand AS made FROM part")
def h7_map_entries(t):
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")
    entries = F.map_entries(m)
    made = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("p_brand", "p_type"))
    return t.part.select("p_partkey", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("entries"), F.element_at(F.map_from_entries(entries), "type").alias("back"), F.element_at(made, "a").alias("made"))


@R.query("SELECT event_id, json_extract_string(props, '$.k') AS k, cast(json_extract(props, '$.k') AS BIGINT) AS kk, json_keys(props) AS names, '{\"u\":' || user_id || '}' AS js, 3 AS len FROM events")
def h8_json(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), parsed["k"].alias("kk"), F.json_object_keys("props").alias("names"), F.to_json(F.struct(F.col("user_id").alias("u"))).alias("js"), F.json_array_length(F.lit("[1,2,3]")).alias("len"))


@R.query("SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def h8_variant(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@R.query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def h8_variant_explode(t):
    """A row for each field of a variant, by a table function."""
    return t.sql("SELECT event_id, v.key AS key, CAST(v.value AS STRING) AS value FROM {events}, LATERAL variant_explode(parse_json(props)) AS v", "events")


@R.query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, 'a b' AS decoded, page_id::INT AS n, 'v' AS x FROM pages")
def h9_url_csv_xml(t):
    row = F.from_csv(F.concat(F.col("page_id").cast("string"), F.lit(",q")), "n int, s string")
    xml = F.from_xml(F.lit("<r><x>v</x></r>"), "x string")
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.url_decode(F.lit("a%20b")).alias("decoded"), row["n"].alias("n"), xml["x"].alias("x"))


@R.query("SELECT p_partkey, p_brand AS brand, p_size::INT AS size, [p_brand, p_type] AS texts, p_name AS decoded, p_partkey::BIGINT AS n, p_type AS x FROM part")
def h9_columns(t):
    """xpath, url_decode, from_csv and from_xml on columns of the table."""
    xml = F.concat(F.lit("<p><b>"), "p_brand", F.lit("</b><b>"), "p_type", F.lit("</b><s>"), F.col("p_size").cast("string"), F.lit("</s></p>"))
    row = F.from_csv(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand"), "n bigint, s string")
    parsed = F.from_xml(F.concat(F.lit("<r><x>"), "p_type", F.lit("</x></r>")), "x string")
    return t.part.select("p_partkey", F.xpath_string(xml, F.lit("p/b[1]")).alias("brand"), F.xpath_int(xml, F.lit("p/s")).alias("size"), F.xpath(xml, F.lit("p/b/text()")).alias("texts"), F.url_decode(F.url_encode("p_name")).alias("decoded"), row["n"].alias("n"), parsed["x"].alias("x"))
