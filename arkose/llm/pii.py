"""Personal data: four kinds by their form, secrets, and others by bootstrapped contexts.

The spans found by form are the seeds: e-mail and IP addresses, card and phone numbers,
and secrets of forms that hardly anything else has (long hexadecimal keys, tokens with
the usual prefixes). Each seed, and each other token with digits that might be an
identifier, is an instance; the words around it, on both sides or on one, and its own
shape are its patterns. Spark scores the graph of patterns and instances in rounds: a
pattern is as good as the share of its instances that are known, an instance as good as
the mean of its patterns. The tokens of the patterns that end with high confidence are
new spans. A token that has a kind's form and fails its check (a number that fails Luhn, a
part over 255) is known not to be of that kind: only a mark that announces a value, as in
token = "...", is a pattern of it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.llm.common import forget, fresh, mapped, parted, settled, slices, typed
from arkose.shipping import shipped

KINDS = ("email", "ip", "card", "phone")
#: Kinds that are added to these and come after them: secrets by form, and what contexts find.
SECRET, FOUND = "secret", "id"
ALL_KINDS = (*KINDS, SECRET, FOUND)
ROUNDS = 3
#: A pattern counts if so many known instances have it and at least this share of all
#: its instances is known; the share for the last step.
LEAST_KNOWN, LEAST_SHARE, SURE = 3, 0.5, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from inside, too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# Forms of secrets (hexadecimal keys of 32 digits or more, of both letters
# and digits; access keys, tokens and web tokens by their prefixes).
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"
)
_EDGE = ".,;:!?\"'`()[]{}<>|*$%&#=+-/\\"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds by start, then kind; leftmost and not
    overlapping in each kind. In time linear in the text."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


class _Clear:
    """Tells, for stretches that come in order, which lie clear of the given spans."""

    def __init__(self, spans):
        self._ends: list[list[int]] = []
        for a, b in sorted(spans):
            if self._ends and a < self._ends[-1][1]:
                self._ends[-1][1] = max(b, self._ends[-1][1])
            else:
                self._ends.append([a, b])
        self._at = 0

    def __call__(self, a: int, b: int) -> bool:
        while self._at < len(self._ends) and self._ends[self._at][1] <= a:
            self._at += 1
        return self._at == len(self._ends) or self._ends[self._at][0] >= b


def secret_spans(text: str, base) -> list[tuple[int, int]]:
    """(start, end) of secrets by form that lie clear of the base spans."""
    clear = _Clear((a, b) for a, _, b in base)
    return [m.span() for m in _SECRET.finditer(text) if clear(*m.span())]


def _word(raw: str) -> str:
    return raw.strip(_EDGE).lower() or raw


#: Marks that announce a value.
_CUES = frozenset(":=#\"'")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
_MIXED = re.compile(r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}")


def shape(token: str) -> str:
    """A token's form: x and a length for a run of 8 hexadecimal digits or more of both
    kinds, a for letters, 9 for each digit (up to three in a row between dots: one 9)."""
    core = _MIXED.sub(lambda m: f"x{len(m[0])}", token.strip(_EDGE))
    if _IP.fullmatch(core):
        return "9.9.9.9"
    parts = re.split(r"(x[0-9]+)", core)
    return "".join(part if i % 2 else _DIGITS.sub(lambda m: "9" * len(m[0]), _LETTERS.sub("a", part)) for i, part in enumerate(parts))


def rejected(token: str) -> bool:
    """Whether a token has the form of an IP address or a card and fails its check."""
    if _IP.fullmatch(token):
        return not all(map(_small, token.split(".")))
    digits = token.replace(" ", "").replace("-", "")
    return _CARD.fullmatch(token) is not None and 14 <= len(digits) <= 19 and not luhn(digits)


def names(core: str, before2: str, before: str, after: str, announced: str) -> list[str]:
    """The patterns of an instance: two words before it, one on each side, its shape, and its
    shape after a word; where marks announce it (`announced`), the word before with them.
    A plain word on one side says nothing: most instances may be known."""
    two = f"2\0{before2}\0{before}"
    found = [two, f"L\0{before}\0{announced}"] if announced and _LETTERS.search(before) else [two] if announced else []
    if not rejected(core.strip(_EDGE)):
        form = shape(core)
        found += [f"1\0{before}\0{after}", f"S\0{form}", f"T\0{form}\0{before}"] + [two] * (not announced)
    return found


def contexts(text: str, spans) -> list[tuple[int, int, str, bool, list[int]]]:
    """(start, end, instance, known, pattern hashes) of the seeds, of other tokens that hold
    a digit or an @ and lie clear of all seeds, and of runs of such tokens."""
    if not spans and not _DIGIT.search(text) and "@" not in text:
        return []
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]
    from bisect import bisect_left, bisect_right

    out = []

    def add(start, end, known):
        i, j = bisect_right(starts, start) - 1, bisect_left(starts, end)
        word = lambda k: _word(text[slice(*tokens[k])]) if 0 <= k < len(tokens) else "^"
        marks = (text[tokens[i - 1][1] - 1] if i > 0 else "") + text[tokens[i][0] : start][-8:]
        patterns = names(text[start:end], word(i - 2), word(i - 1), word(j), marks if _CUES.intersection(marks) else "")
        out.append((start, end, text[start:end].lower(), known, [xxhash.xxh64_intdigest(n.encode()) - (1 << 63) for n in patterns]))

    taken = sorted((a, b) for a, _, b in spans)
    for a, b in taken:
        add(a, b, True)
    clear = _Clear(taken)
    run: list[tuple[int, int]] = []

    def close():
        if len(run) > 1:
            add(run[0][0], run[-1][1], False)
        run.clear()

    for a, b in tokens:
        piece = text[a:b]
        left = len(piece) - len(piece.lstrip(_EDGE))
        core = piece.strip(_EDGE)
        if not _DIGIT.search(core) and "@" not in core:
            close()
            continue
        a, b = a + left, a + left + len(core)
        if not clear(a, b):
            close()
            continue
        run.append((a, b))
        add(a, b, False)
    close()
    return out


def _key(text: str) -> bytes:
    return hashlib.md5(text.encode(), usedforsecurity=False).digest()


def hidden(seed: str, hide: int) -> bool:
    return xxhash.xxh64_intdigest(seed.lower().encode(), 7) % hide == 0


@shipped
def occurrences(df: DataFrame, text_col: str = "text", hide: int = 0) -> DataFrame:
    """Rows (key, start, end, known, instance, pattern) of all texts; key is the text's MD5.
    With `hide`, one seed in so many, by its hash, is treated as unknown, to measure how
    many of them the rounds find again."""

    def run(batches):
        for batch in slices(batches, 0):
            rows = []
            for text in batch.column(0).to_pylist():
                if text:
                    key = None
                    base = base_spans(text)
                    seeds = base + [(a, len(KINDS), b) for a, b in secret_spans(text, base)]
                    if hide:
                        seeds = [s for s in seeds if not hidden(text[s[0] : s[2]], hide)]
                    for a, b, instance, known, patterns in contexts(text, seeds):
                        key = key or _key(text)
                        h = xxhash.xxh64_intdigest(instance.encode()) - (1 << 63)
                        rows += [(key, a, b, known, h, p) for p in patterns]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["key", "start", "end", "known", "instance", "pattern"])

    return df.select(text_col).mapInArrow(run, "key binary, start long, end long, known boolean, instance long, pattern long")


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """From rows (pattern, instance, known): (pattern, share, support) after the rounds.

    share is the mean worth of the pattern's distinct instances, support the sum. Known
    instances are worth 1, others 0 at first and then the mean over their patterns with
    enough support of the shares that are large enough (others count 0). Each round's results are written: both inputs of every
    join are then read as they are, so Spark can split a pattern of very many instances.
    """
    edges = settled(edges.groupBy("pattern", "instance").agg(F.max("known").alias("known")))
    known = settled(edges.groupBy("instance").agg(F.max("known").alias("known")))
    worth, old = known.select("instance", F.col("known").cast("double").alias("worth")), [edges, known]
    for r in range(rounds):
        each = edges.select("pattern", "instance").join(worth, "instance")
        patterns = settled(each.groupBy("pattern").agg(F.avg("worth").alias("share"), F.sum("worth").alias("support")))
        if r < rounds - 1:
            counting = F.when(F.col("support") >= LEAST_KNOWN, F.when(F.col("share") >= LEAST_SHARE, F.col("share")).otherwise(0.0))
            better = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg(F.avg(counting).alias("mean"))
            worth = settled(known.join(better, "instance").select("instance", F.when(F.col("known"), 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("worth")))
            old += [patterns, worth]
    forget(*old)
    return patterns


def discovered(df: DataFrame, text_col: str = "text", hide: int = 0) -> DataFrame:
    """(key, extra): the spans that contexts add to the texts with this MD5, as an array
    of (start, end) in order, without those inside others.

    Texts without any are left out, so also null and empty ones; equal texts are one; an
    empty table gives no row; texts may have any length; other columns are ignored. The
    result is a written table, so its size is known where it is joined.
    """
    seen = settled(occurrences(df, text_col, hide).distinct())
    patterns = scored_patterns(seen.select("pattern", "instance", "known"))
    sure = settled(patterns.where((F.col("support") >= LEAST_KNOWN) & (F.col("share") >= SURE)).select("pattern"))
    places = seen.where(~F.col("known")).join(sure, "pattern").select("key", "start", "end").distinct()
    before = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = places.withColumn("reached", F.max("end").over(before)).where("reached IS NULL OR end > reached")  # else inside an earlier one
    found = settled(outer.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("extra")))
    forget(seen, sure, patterns)
    return found


@shipped
def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and extra as arrays of (start, kind, end), in code points. extra
    has the secrets by form (kind `secret`) and what contexts find (kind `id`).

    A null text counts as empty; a null id is kept; equal texts give equal spans; texts
    are searched whole; an empty table gives no row; other columns are ignored.
    """
    shape = "array<struct<start:long,kind:string,end:long>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    given = lambda found: [{"start": a, "kind": k, "end": b} for a, k, b in found]

    def run(batches):
        for batch in slices(batches):
            keys, base, more = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                keys.append(_key(text))
                base.append(given((a, KINDS[k], b) for a, k, b in found))
                more.append(given((a, SECRET, b) for a, b in secret_spans(text, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(base, arrow), pa.array(more, arrow)], names=["id", "key", "base", "secrets"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = source.mapInArrow(run, typed(source, "id", f"key binary, base {shape}, secrets {shape}"))
    docs = docs.join(discovered(df, text_col), "key", "left")
    extra = F.transform(F.coalesce("extra", F.array().cast("array<struct<start:long,end:long>>")), lambda s: F.struct(s["start"].alias("start"), F.lit(FOUND).alias("kind"), s["end"].alias("end")))
    return docs.select(F.col("id").alias(id_col), "base", F.concat("secrets", extra).alias("extra"))


def listed(spans_: "F.Column") -> "F.Column":
    """kind:start:end of each span by start, then kind as listed, joined by commas."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(ALL_KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_text(text: str, extra=()) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping
    spans the whole stretch is replaced by the name of the first."""
    out, at, name = [], 0, None
    runs: list[list] = []
    base = base_spans(text)
    secrets = [(a, len(KINDS), b) for a, b in secret_spans(text, base)]
    for a, k, b in sorted([*base, *secrets, *[(a, len(KINDS) + 1, b) for a, b in extra]]):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, ALL_KINDS[k].upper()])
    for a, b, name in runs:
        out += [text[at:a], f"<{name}>"]
        at = b
    return "".join(out) + text[at:] if out else text


@shipped
def masked(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`df` with its personal data masked in `text_col`, and `length_col`, if there is
    one, set to the new number of code points; other columns, of any name, stay.

    Null texts stay null (length kept) and empty ones empty; texts are masked whole,
    however long; repeated rows are masked alike; an empty table gives no row. Only rows
    whose text may have spans found by context are shuffled to them.
    """
    columns = df.columns
    t, has = columns.index(text_col), length_col in columns

    def run(batches):
        for batch in slices(batches, t):
            texts = batch.column(t).to_pylist()
            extra = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else [None] * len(texts)
            new = [None if x is None else masked_text(x, [(s["start"], s["end"]) for s in e or ()]) for x, e in zip(texts, extra)]
            cols = [batch.column(i) for i in range(len(columns))]
            cols[t] = pa.array(new, cols[t].type)
            if has:
                n = columns.index(length_col)
                cols[n] = pa.array([old if x is None else len(x) for x, old in zip(new, cols[n].to_pylist())], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(columns))])

    key, more = fresh(df, "key"), fresh(df, "extra")
    found = discovered(df, text_col).toDF(key, more)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    maybe, rest = parted(df, digest, found.select(key))
    maybe = maybe.withColumn(key, digest).join(found.hint("shuffle_hash"), key, "left")
    maybe = maybe.select(*[F.col(f"`{c}`") for c in columns], more)
    return mapped(rest, run, df.schema).union(mapped(maybe, run, df.schema))
