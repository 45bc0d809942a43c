"""Near-duplicates by MinHash: min-wise signatures, bands, exact Jaccard, components.

A text's set are its runs of WORDS words (of a shorter text, all its words as one run). The
least values that PERMUTATIONS hash functions take on a set are its signature; two sets
agree in one of them with a probability of their Jaccard similarity. Sets that agree in a
whole band of their signatures meet in a bucket and are compared exactly.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkose.operators.filters import parted
from arkose.operators.graphs import stars
from arkose.operators.text import words
from arkose.registry import Registry
from arkose.storage import forget, settled

R = Registry()
WORDS, SIMILAR = 5, 0.8
#: Sets of similarity 0.8 meet with a probability of 1 - (1 - 0.8^6)^13 = 0.981, of 0.85 with
#: 0.998, of 0.2 with 0.0008. Many more functions than this make code that the JVM does not compile.
BANDS, IN_BAND = 13, 6
_PRIME = (1 << 31) - 1
#: Digits of an MD5 that make a run's hash, which fits in a long.
_DIGITS = 15


def permutations(count: int) -> list[tuple[int, int]]:
    """(a, b) of the functions x -> (a x + b) mod 2^31 - 1."""
    number = lambda name: int(md5(name.encode()).hexdigest()[:12], 16)
    return [(1 + number(f"a{i}") % (_PRIME - 1), number(f"b{i}") % _PRIME) for i in range(count)]


def _hashed(run: Column) -> Column:
    return F.conv(F.substring(F.md5(run), 1, _DIGITS), 16, 10).cast("long")


def _key(w: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(w, " "), 256))


def signatures(df: DataFrame, id_col: str, text_col: str, count: int = BANDS * IN_BAND) -> DataFrame:
    """(node, id, key, signature) of each different text, by its words: a number, its least id,
    the SHA-256 of its words, and its signature (null without words). An aggregate with a
    partial step: of each text one short row a task is shuffled, and copies are merged
    where they lie."""
    rows = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).select("id", "w", _key(F.col("w")).alias("key"))
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0))))
    at = rows.select("id", "key", "w", F.explode_outer(places).alias("i"))
    run = F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(WORDS)])  # what lies beyond a short text is left out
    hashes = at.select("id", "key", F.when(F.col("i").isNotNull(), run).alias("run")).select("id", "key", F.inline(F.array(F.struct((_hashed(F.col("run")) % _PRIME).alias("h")))))
    least = [F.min((F.col("h") * a + b) % _PRIME).cast("int").alias(f"m{i}") for i, (a, b) in enumerate(permutations(count))]
    sums = hashes.groupBy("key").agg(F.min("id").alias("id"), *least)
    signature = F.when(F.col("m0").isNotNull(), F.array(*[f"m{i}" for i in range(count)]))
    return settled(sums.select(F.monotonically_increasing_id().alias("node"), "id", "key", signature.alias("signature")))


def buckets(signed: DataFrame, bands: int = BANDS, in_band: int = IN_BAND) -> DataFrame:
    """(band, value, node, leader) for each band of a signature that another one shares; the
    leader is the bucket's least node. Buckets of one are dropped before, so only
    written tables meet and Spark can split a bucket of very many texts."""
    parts = [F.struct(F.lit(b).cast("short").alias("band"), F.xxhash64(F.slice("signature", b * in_band + 1, in_band)).alias("value")) for b in range(bands)]
    keyed = signed.where("signature IS NOT NULL").select("node", F.inline(F.array(*parts)))
    shared = settled(keyed.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n"))
    return settled(keyed.join(shared, ["band", "value"]))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the hashes of the runs of the texts of `wanted` (node, id, key). Only
    rows that a filter of bounded size takes for one of them are shuffled."""
    rows = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    rows = rows.select(F.struct("id", _key(F.col("w")).alias("key")).alias("mine"), "w")
    asked = wanted.select("node", F.struct("id", "key").alias("theirs"))
    maybe, _ = parted(rows, F.col("mine"), asked.select("theirs"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (WORDS - 1), F.lit(1))), lambda i: _hashed(F.array_join(F.slice("w", i, WORDS), " ")))
    same = F.col("mine.key") == F.col("theirs.key")
    found = maybe.join(asked, same & F.col("mine.id").eqNullSafe(F.col("theirs.id"))).select("node", F.array_sort(F.array_distinct(runs)).alias("shingles"))
    return settled(found.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "zstd")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Those (u, v) of written `pairs` whose sets have a Jaccard similarity of the threshold
    or more. A node in very many pairs meets written tables, so Spark can split it."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    size_u, size_v = F.size("of_u"), F.size("of_v")
    common = F.size(F.array_intersect("of_u", "of_v"))
    near = F.least(size_u, size_v) >= threshold * F.greatest(size_u, size_v) - 1e-9  # else not similar, and not intersected
    return both.where(near & (F.when(near, common / (size_u + size_v - common)) >= threshold)).select("u", "v")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR, bands: int = BANDS, in_band: int = IN_BAND) -> DataFrame:
    """Per row of `df`: id and class_id, the least id that links reach. Texts are linked if
    they share a band and their sets have a similarity of the threshold or more.

    Each text of a bucket is compared with the bucket's leader. What that links is one
    component; texts of a bucket that are not of its largest component are then compared with
    all texts of the bucket that are of another one. So every two texts of a bucket are
    in one component or were compared, and a group of very many alike makes no pairs.

    Words are lower case. Texts without words (null, empty) are one class. Null ids are not
    least, unless a class has no other: then its class_id is null. Repeated rows are of
    one class. An empty table gives no row. Other columns are ignored.
    """
    signed = signatures(df, id_col, text_col, bands * in_band)
    members = buckets(signed, bands, in_band)
    sets = shingle_sets(df, id_col, text_col, settled(members.select("node").distinct()).join(signed, "node").select("node", "id", "key"))
    pairs = settled(members.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct())
    links = settled(similar(pairs, sets, threshold))
    roots = stars(links)
    rooted = settled(members.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")))
    bucket = ["band", "value"]
    counts = rooted.groupBy(*bucket, "root").agg(F.count("*").alias("n"))
    mixed = settled(counts.groupBy(*bucket).agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("major")).where("roots > 1"))
    inside = settled(rooted.join(mixed.drop("roots"), bucket))
    strays = settled(inside.where("root <> major AND node <> leader").select(*bucket, F.col("node").alias("stray"), F.col("root").alias("other")))
    met = inside.where("node <> leader").join(strays, bucket).where("root <> other")
    more = settled(met.select(F.least("node", "stray").alias("u"), F.greatest("node", "stray").alias("v")).distinct())
    final = stars(links.union(similar(more, sets, threshold)))
    final = final.union(final.select("v", "v").distinct()).toDF("node", "root")
    least = signed.join(final, "node").groupBy("root").agg(F.min("id").alias("least"))
    linked = settled(final.join(least, "root").select("node", "least", F.lit(True).alias("linked")))
    classes = settled(signed.join(linked, "node", "left").select("key", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("class_id")))
    forget(members, sets, pairs, rooted, mixed, inside, strays, more)
    rows = df.select(F.col(id_col).alias("id"), _key(words(F.col(text_col))).alias("mine"))
    return rows.join(classes, F.col("mine") == F.col("key")).select(F.col("id").alias(id_col), "class_id")


_PAIRS = ", ".join(f"({a}, {b})" for a, b in permutations(BANDS * IN_BAND))


@R.query(f"""WITH RECURSIVE p(i, a, b) AS (SELECT row_number() OVER () - 1, col0, col1 FROM (VALUES {_PAIRS})
), w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\s]+') AS w FROM documents
), k AS MATERIALIZED (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM w
), n AS MATERIALIZED (SELECT min(doc_id) AS node, any_value(w) AS w, key FROM k GROUP BY key
), s AS MATERIALIZED (
  SELECT DISTINCT node, ('0x' || substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, {_DIGITS}))::BIGINT AS h
  FROM (SELECT node, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM n WHERE len(w) > 0)
), m AS (SELECT node, i, min((a * (h % {_PRIME}) + b) % {_PRIME}) AS m FROM s, p GROUP BY node, i
), b AS MATERIALIZED (SELECT node, i // {IN_BAND} AS band, list(m ORDER BY i) AS value FROM m GROUP BY ALL
), c AS (SELECT DISTINCT x.node AS u, y.node AS v FROM b x JOIN b y ON x.band = y.band AND x.value = y.value AND x.node < y.node
), z AS (SELECT node, count(*) AS size FROM s GROUP BY node
), j AS (SELECT u, v, count(*) AS shared FROM c JOIN s x ON x.node = u JOIN s y ON y.node = v AND x.h = y.h GROUP BY u, v
), e AS MATERIALIZED (SELECT u, v FROM j JOIN z x ON x.node = u JOIN z y ON y.node = v WHERE shared / (x.size + y.size - shared) >= {SIMILAR}::DOUBLE
), g AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r(node, root) AS (SELECT node, node FROM n UNION SELECT g.v, r.root FROM r JOIN g ON r.node = g.u
), f AS (SELECT node, min(root) AS class_id FROM r GROUP BY node)
SELECT k.doc_id, f.class_id FROM k JOIN n USING (key) JOIN f ON f.node = n.node""")
def k2_minhash(t):
    """Classes of near-duplicate documents: 5-word runs, similarity 0.8 or more."""
    return near_duplicates(t.documents)
