"""Importance resampling towards a target distribution, with DataFrame functions only.

Each text's runs of one to three words fall into buckets by CRC-32. How much more often a
bucket occurs in the target than in the corpus is its gain; a text's weight is the sum of
its runs' gains. Gumbel noise from a hash of the id is added, and the highest scores are
drawn: a sample without replacement in proportion to the exponents of the weights.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import forget, fresh, parted, settled
from arkose.operators.ordered import numbered

#: Words hold small ASCII letters, digits and all characters from 128 on.
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUNS, BUCKETS, SEED = 3, 10_000, 42
LEAST_WORDS, PERCENT = 20, 5
#: Gains and noise are whole numbers of this fraction of a nat.
PARTS = 1000.0


def words(text: Column) -> Column:
    """A-Z in lower case, then the words; none for null. Cutting at the gaps takes time in
    proportion to the text, where regexp_extract_all copies the text for each match."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), f"[{_GAP}]+"), "")


def features(n_words: Column, runs: int = RUNS) -> Column:
    """How many runs of 1 to `runs` consecutive words so many words have."""
    return reduce(lambda a, b: a + b, [F.greatest(n_words - k, F.lit(0)) for k in range(runs)])


def grams(df: DataFrame, runs: int = RUNS) -> DataFrame:
    """From rows with a column `words`: the other columns and `gram`, a row for each run of
    1 to `runs` words. Near the end of a text, and for one without words, some are null.

    A text's places are exploded, then each place's array of runs, so that no array of all
    runs of a long text is ever built."""
    others = [F.col(f"`{c}`") for c in df.columns if c != "words"]
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    at = df.select(*others, "words", F.explode_outer(places).alias("__i"))
    word = [F.get("words", F.col("__i") + k) for k in range(runs)]
    run = lambda k: F.concat(*[x for w in word[:k] for x in (w, F.lit(" "))], word[k])
    return at.select(*others, F.explode(F.array(*[run(k) for k in range(runs)])).alias("gram"))


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(gram) % buckets).cast("int")


def counted(texts: Column, df: DataFrame, runs: int, buckets: int) -> DataFrame:
    """Per bucket the runs of all texts in it: at most `buckets` rows from each task are
    shuffled, and a table of at most `buckets` rows is written."""
    hits = grams(df.select(words(texts).alias("words")), runs).where("gram IS NOT NULL")
    return settled(hits.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """From `counted` of corpus and target: bucket and gain, a row for every bucket, so the
    size of the table is the parameter `buckets` whatever the texts."""
    total = lambda t: t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_s, all_t = total(corpus), total(target)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    ratio = number("t") * F.lit(float(all_s + buckets)) / (number("s") * F.lit(float(all_t + buckets)))
    return settled(rows.select("bucket", F.floor(F.lit(PARTS) * F.ln(ratio)).alias("gain")))


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in PARTS from the first 8 hexadecimal digits of the SHA-256 of seed:id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-PARTS) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of `df`: id, n_features, weight, score, and rank (from 1; null if not drawn).

    Of the rows with at least `least_words` words the floor of `percent` hundredths is
    drawn, by falling score, ties to the smaller id. Each row counts for itself: repeated
    rows have equal scores and ranks of their own, a row with a null id has the noise of an
    empty one and comes last among ties. A null, empty or wordless text has no features and
    weight 0; an empty target is a flat distribution; an empty `df` gives no row. Texts count
    whole; other columns of both tables are ignored.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    corpus, aim = counted(F.col("text"), source, runs, buckets), counted(F.col(target_col), target, runs, buckets)
    gain = gains(corpus, aim, buckets)
    rows = source.select(F.monotonically_increasing_id().alias("row"), "id", words(F.col("text")).alias("words"))
    rows = rows.select("row", "id", F.size("words").alias("n"), "words")
    hits = grams(rows, runs).withColumn("bucket", bucket(F.col("gram"), buckets))
    sums = hits.join(F.broadcast(gain), "bucket", "left").groupBy("row", "id", "n").agg(F.coalesce(F.sum("gain"), F.lit(0).cast("long")).alias("weight"))
    scored = settled(sums.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    forget(corpus, aim, gain)
    mine = F.col("n") >= least_words
    most = scored.where(mine).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    placed = numbered(scored.where(mine), order, "place").withColumn("rank", F.when(F.col("place") <= most, F.col("place")))
    out = placed.drop("place").union(scored.where(~mine).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), features(F.col("n").cast("long"), runs).alias("n_features"), "weight", "score", "rank")


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of `df`, with all its columns, of any name: those whose id `ranked`
    draws (rows of one id stay or go together). Only rows that a filter of the drawn ids
    lets through are shuffled."""
    drawn = settled(ranked(df, target, id_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("id")).distinct())
    maybe, _ = parted(df, F.col(f"`{id_col}`"), drawn)
    key = fresh(df, "id")
    return maybe.join(drawn.withColumnRenamed("id", key), F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_semi")


ORACLE = rf"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range::UBIGINT, 0, range::UBIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8
), steps AS MATERIALIZED (SELECT list(c ORDER BY b) AS step FROM bits WHERE k = 8
), w AS MATERIALIZED (
  SELECT true AS mine, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark
), v AS MATERIALIZED (
  SELECT mine, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^{_GAP}]+') AS w FROM w
), g AS MATERIALIZED (
  SELECT mine, id, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT mine, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM v, (SELECT unnest(range(1, {RUNS} + 1)) AS n))
), u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)
), c AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::UBIGINT),
    lambda c, x: xor(c >> 8, step[(xor(c, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % {BUCKETS} AS bucket FROM u, steps
), k AS MATERIALIZED (SELECT mine, id, bucket, count(*) AS n FROM g JOIN c USING (f) GROUP BY ALL
), s AS (SELECT bucket, coalesce(sum(n) FILTER (mine), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT mine), 0)::DOUBLE AS t FROM k GROUP BY bucket
), gain AS (
  SELECT bucket, floor({PARTS}::DOUBLE * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM s
), d AS (SELECT id, sum(n * gain)::BIGINT AS weight FROM k JOIN gain USING (bucket) WHERE mine GROUP BY id
), e AS (
  SELECT id, len(w)::BIGINT AS n, coalesce(weight, 0) AS weight, ('0x' || left(sha256('{SEED}:' || id), 8))::BIGINT::DOUBLE AS h FROM v LEFT JOIN d USING (id) WHERE mine
), f AS (SELECT id, n, weight, weight + floor(-{PARTS}::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e
), r AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, id) AS place, count(*) FILTER (n >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS most FROM f)
SELECT id AS doc_id, {" + ".join(f"greatest(n - {i}, 0)" for i in range(RUNS))} AS n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND place <= most THEN place END AS rank FROM r
"""
