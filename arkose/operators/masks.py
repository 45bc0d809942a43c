"""Masks of licence lines and personal data, with array functions only.

Of each line the spans of all patterns are listed, those that touch or overlap are merged,
and the line is put together again from what lies between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arkose.registry import Registry

R = Registry()
#: By name, the patterns of a line; the first name wins where spans begin together.
PATTERNS = {
    "LICENSE": "^[^\\n]*([Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Cc]opyright|SPDX)[^\\n]*",
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+",
    "IP": "[0-9]{1,3}([.][0-9]{1,3}){3}",
    "KEY": "[0-9a-f]{32,}",
    "PHONE": "[+][0-9][ ().0-9-]{8,}[0-9]",
}
#: The same matches in time linear in the line: a run of letters that fails from its start
#: fails from inside, too, so only its start and the end of the last match are tried.
LINEAR = PATTERNS | {"EMAIL": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"}
_OPEN, _CLOSE = "\x01", "\x02"


_SPANS = "array<struct<start:int,rank:int,end:int,name:string>>"


def spans(line: Column, pattern: str, name: str, rank: int) -> Column:
    """Of a pattern's matches in a line the array of (start, rank, end, name), from 0, end
    exclusive. Matches are marked and the line is split at the marks, so pieces outside
    and inside come in turn; marks that it has itself are taken for spaces."""
    plain = F.translate(line, _OPEN + _CLOSE, "  ")
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPANS).alias("found"))

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.length(part)
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(name).alias("name"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def merged(found: Column) -> Column:
    """Spans in order, those that touch or overlap made one, named by the first of them."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"), last["name"].alias("name"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))
        return F.when(s["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(found), F.array().cast(_SPANS), step)


def masked(text: Column, patterns: dict[str, str] = LINEAR) -> Column:
    """The text with each merged span of its lines replaced by its name in angle brackets. A
    null text stays null, an empty one empty; each line is masked for itself, so the time
    grows with the text and with the square of a line's spans."""
    any_ = "|".join(f"({p})" for p in patterns.values())

    def line(s: Column) -> Column:
        cuts = merged(F.concat(*[spans(s, p, n, i) for i, (n, p) in enumerate(patterns.items())]))
        head = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
        between = lambda a, to: F.substring(s, a["at"] + 1, to - a["at"])
        cut = lambda a, c: F.struct(c["end"].alias("at"), F.concat(a["done"], between(a, c["start"]), F.lit("<"), c["name"], F.lit(">")).alias("done"))
        return F.when(F.regexp_like(s, F.lit(any_)), F.aggregate(cuts, head, cut, lambda a: F.concat(a["done"], between(a, F.length(s))))).otherwise(s)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


_MATCHES = " UNION ALL ".join(
    rf"SELECT doc_id, n, line, {i} AS rank, '{name}' AS name, string_split_regex(regexp_replace(line, '({pattern})', chr(1) || '\1' || chr(2), 'g'), '[\x01\x02]') AS parts FROM l" for i, (name, pattern) in enumerate(PATTERNS.items())
)


@R.query(rf"""WITH l AS MATERIALIZED (SELECT doc_id, n, lines[n] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), m AS ({_MATCHES}
), s AS (
  SELECT doc_id, n, line, rank, name, coalesce(list_sum(list_transform(parts[:2 * i - 1], lambda x: len(x))), 0)::INT AS a, list_sum(list_transform(parts[:2 * i], lambda x: len(x)))::INT AS b
  FROM (SELECT *, unnest(range(1, len(parts) // 2 + 1)) AS i FROM m)
), w AS (SELECT *, max(b) OVER (PARTITION BY doc_id, n ORDER BY a, rank, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s
), i AS (SELECT *, sum(CASE WHEN a <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, n ORDER BY a, rank, b ROWS UNBOUNDED PRECEDING) AS island FROM w
), c AS (SELECT doc_id, n, any_value(line) AS line, island, min(a) AS a, max(b) AS b, first(name ORDER BY a, rank, b) AS name FROM i GROUP BY doc_id, n, island
), g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id, n ORDER BY a), 0) AS past FROM c
), x AS (SELECT doc_id, n, string_agg(substr(line, past + 1, a - past) || '<' || name || '>', '' ORDER BY a) || substr(any_value(line), max(b) + 1) AS masked FROM g GROUP BY doc_id, n)
SELECT doc_id, string_agg(coalesce(masked, line), chr(10) ORDER BY n) AS text FROM l LEFT JOIN x USING (doc_id, n) GROUP BY doc_id""")
def k4_masks(t):
    """Documents with licence lines, addresses, keys and phone numbers masked."""
    return t.documents.select("doc_id", masked(F.col("text")).alias("text"))
