"""Text tables: exact copies, shared passages, pages, vectors, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.operators.filters import member_test
from arkose.registry import Registry
from arkose.storage import settled

R = Registry()


def first_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each text the least id: an aggregate over hashes, with a partial step, so a
    text of many copies is never gathered and no text is shuffled."""
    return df.groupBy(F.sha2(text_col, 256).alias("hash")).agg(F.min(id_col).alias(id_col))


@R.query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def k1_exact_dedup(t):
    return first_copies(t.documents, "doc_id", "text").select("doc_id")


_GRAMS = """SELECT DISTINCT {id}, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 7)) AS i
  FROM (SELECT {id}, regexp_extract_all(lower(text), '[^\\s]+') AS w FROM {table}))"""


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def word_runs(df: DataFrame, id_col: str, n: int = 8, wanted=None) -> DataFrame:
    """(id, gram, h): the runs of n words of `text`, repeats included, with their hash. With
    `wanted`, a test of hashes, only runs that pass it leave the scan of `df`: a text's places
    are exploded, and each run is hashed and tested where it is made."""
    rows = df.select(id_col, words(F.col("text")).alias("w")).where(F.size("w") >= n)
    places = rows.select(id_col, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
    gram = F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(n)])
    made = places.select(id_col, gram.alias("gram")).select(id_col, F.inline(F.array(F.struct("gram", F.xxhash64("gram").alias("h")))))
    return made if wanted is None else made.where(wanted(F.col("h")))


def shared_runs(df: DataFrame, items: DataFrame, id_col: str, item_col: str, n: int = 8) -> DataFrame:
    """(id, item, shared): how many different runs of n words a text of `df` shares with a
    text of `items`, where there is one. Null ids are ids of their own, rows of one id are
    one text cut in parts; null, empty and short texts share nothing.

    The items' hashes make a filter of bounded size, and what passes it meets the items'
    written runs, hash and words alike, so equal hashes of different runs count for nothing.
    """
    theirs = settled(word_runs(items, item_col, n).groupBy(item_col, "gram", "h").agg(F.lit(1).alias("one")).drop("one"))
    mine = word_runs(df, id_col, n, member_test(theirs.select("h").distinct()))
    hits = mine.join(theirs, ["h", "gram"]).groupBy(id_col, item_col, "gram").agg(F.lit(1).alias("one"))
    return hits.groupBy(id_col, item_col).agg(F.count("*").alias("shared"))


@R.query("WITH d AS (" + _GRAMS.format(id="doc_id", table="documents") + "), b AS (" + _GRAMS.format(id="item_id", table="benchmark") + ") SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (gram) GROUP BY ALL")
def k3_decontamination(t):
    """Documents that share runs of 8 words with a benchmark item."""
    return shared_runs(t.documents, t.benchmark, "doc_id", "item_id")


@R.query(r"SELECT doc_id, len(regexp_extract_all(text, '\w+'))::INT AS words, len(regexp_extract_all(text, '[.!?]'))::INT AS stops, (len(text) - len(replace(text, chr(10), '')) + 1)::INT AS lines, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(len(text), 1), 6) AS upper_share FROM documents")
def k4_text_statistics(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.regexp_count(c, F.lit(r"\w+")).alias("words"), F.regexp_count(c, F.lit("[.!?]")).alias("stops"), (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.round(F.regexp_count(c, F.lit("[A-Z]")) / F.greatest(F.length(c), F.lit(1)), 6).alias("upper_share"))


@R.query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def k5_html_text(t):
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return t.pages.select("page_id", text.alias("text"), F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("host"))


@R.query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
  || regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?#]*', '') AS url FROM pages""")
def k5_normal_urls(t):
    """Scheme and host in lower case, without the scheme's own port or a fragment."""
    front = F.lower(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0))
    for scheme, port in (("http", 80), ("https", 443)):
        front = F.regexp_replace(front, f"^({scheme}://.*):{port}$", "$1")
    rest = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^[A-Za-z]+://[^/?#]*", "")
    return t.pages.select("page_id", F.concat(front, rest).alias("url"))


@R.query("SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS norm FROM embeddings GROUP BY label")
def k6_vector_norms(t):
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(square)), 5).alias("norm"))


@R.query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(length(text))::BIGINT AS chars, string_agg(left(role, 1), '' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def k7_turn_statistics(t):
    shape = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.left("role", F.lit(1)).alias("r")))), lambda x: x["r"])
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.array_join(shape, "").alias("shape"))


@R.query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def k7_turn_order(t):
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
