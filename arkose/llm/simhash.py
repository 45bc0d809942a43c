"""Near-duplicates by SimHash, compared bit-sliced.

Fingerprints within `radius` bits agree on at least `blocks - radius` of `blocks`
blocks, so each table of that many blocks gives buckets in which all links are found.
In a bucket, bit planes lie vertically: one word holds one bit of 64 fingerprints. A
fingerprint meets 64 others at once; carry-save counters add up the differing bits,
and words in which all 64 exceed the radius are abandoned. A bucket over `block_rows`
is cut into blocks whose pairs are solved apart, so no bucket must fit in one task, and
from each comes a forest of its links, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arkose.llm.common import parted, settled, slices
from arkose.operators.graphs import stars
from arkose.shipping import shipped

SEED, SHINGLE = 42, 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of word 4-shingles (XXH64) as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(data, SEED)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()]
    ends = [*gaps[SHINGLE - 1 :].tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    return voted(np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def voted(hashes: np.ndarray) -> int:
    """The SimHash of hashes: the bits that over half of them have; 0 of none."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        ones = np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@shipped
def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masks(radius: int, blocks: int) -> list[int]:
    """Of the tables: each has the bits of blocks - radius of the blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints of one group within the radius. Groups are runs.

    Where a group has both sides 0 and 1, only pairs of different sides are compared.
    """
    n = len(fps)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    word0 = np.r_[0, np.cumsum(words)[:-1]]
    run = np.repeat(np.arange(len(first)), size)
    lane = np.arange(n) - first[run]
    slot = (word0[run] + lane // 64) * 64 + lane % 64
    total = int(words.sum())
    at = np.full(total * 64, -1, np.int64)
    at[slot] = np.arange(n)
    bits = np.zeros((64, total * 64), np.uint8)
    bits[:, slot] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").view(np.uint64)
    on_side = np.zeros((2, total * 64), np.uint8)
    on_side[side.astype(int), slot] = 1
    sides = np.stack([pack(on_side[0]), pack(on_side[1])])
    mixed = np.zeros(len(first), bool)
    np.logical_or.at(mixed, run, side != side[first][run])
    found_i, found_j = [], []
    step = 1 << 18
    count = words[run]
    task_end = np.cumsum(count)
    start = 0
    while start < n:  # query rows in chunks of about `step` words
        stop = max(start + 1, int(np.searchsorted(task_end, (task_end[start - 1] if start else 0) + step, "right")))
        q = np.repeat(np.arange(start, stop), count[start:stop])
        offset = np.arange(len(q)) - np.repeat(np.cumsum(count[start:stop]) - count[start:stop], count[start:stop])
        word = word0[run[q]] + offset
        other = np.where(mixed[run[q]], sides[1 - side[q].astype(int), word], sides[0][word] | sides[1][word])
        mine = slot[q] // 64
        # each pair once: lanes after the query's own
        later = np.where(word > mine, ~np.uint64(0), np.where(word < mine, np.uint64(0), ~np.uint64(0) << (slot[q] % 64).astype(np.uint64) & ~(np.uint64(1) << (slot[q] % 64).astype(np.uint64))))
        live = other & later
        keep = live != 0
        q, word, live = q[keep], word[keep], live[keep]
        sums = np.zeros((3, len(q)), np.uint64)
        for p in range(64):
            carry = planes[p][word] ^ (np.uint64(0) - (fps[q] >> np.uint64(p) & np.uint64(1)))
            for level in range(3):
                sums[level], carry = sums[level] ^ carry, sums[level] & carry
            over = carry | _over(sums, radius)
            live = live & ~over
            if p % 4 == 3:
                keep = live != 0
                if not keep.all():
                    q, word, live, sums = q[keep], word[keep], live[keep], sums[:, keep]
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(hit)
            found_i.append(q[row])
            found_j.append(at[word[row] * 64 + bit])
        start = stop
    if not found_i:
        return none, none
    return np.concatenate(found_i), np.concatenate(found_j)


def _over(sums: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose 3-bit count is over the radius (at most 7)."""
    over, equal = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
    for level in (2, 1, 0):
        if radius >> level & 1:
            equal = equal & sums[level]
        else:
            over = over | (equal & sums[level])
            equal = equal & ~sums[level]
    return over


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the least one reachable by the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


@shipped
def link_forest(fps: DataFrame, radius: int = 4, blocks: int = 6, block_rows: int = 1024, direct: bool = False) -> DataFrame:
    """From distinct fingerprints (fp): edges (u, v), each a chain of links within the
    radius, that connect what the links connect. With `direct` each edge is one link: that
    of a fingerprint to the first in its block, so chains over later ones may be left out."""
    tables = masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])).alias("b")).select("fp", "b.t", "b.key")
    full = settled(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))  # written, so Spark can split a hot bucket
    rows = keys.join(full, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    rows = rows.withColumn("side", (F.col("part") > F.col("i")).cast("byte"))
    by = ["t", "key", "i", "j"]
    rows = rows.repartition(*by).sortWithinPartitions(*by, "side", "fp")

    def solve(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in range(6)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            group = np.r_[False, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)].cumsum()
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            rest = [c[cut:] for c in cols]
            if cut:
                yield edges([c[:cut] for c in cols], group[:cut])
        if rest is not None:
            yield edges(rest, np.zeros(len(rest[0]), np.int64))

    def edges(cols, group):
        fps, side = np.ascontiguousarray(cols[5]), cols[4]
        i, j = links(fps.view(np.uint64), group, side, radius)
        if direct:
            root = np.arange(len(fps))
            np.minimum.at(root, j, i)
        else:
            root = forest(len(fps), i, j)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[root[moved]])], names=["u", "v"])

    return rows.select(*by, "side", "fp").mapInArrow(solve, "u long, v long")


def _classes(df: DataFrame, id_col: str, text_col: str, radius: int = 4, blocks: int = 6, block_rows: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), and for each distinct fingerprint (fp, root, component_id): the
    least fingerprint and the least id (null if there is none) of its component."""
    docs = settled(fingerprints(df, id_col, text_col).select(F.col(id_col).alias("id"), "fp"))
    fps = settled(docs.groupBy("fp").agg(F.min("id").alias("first")))
    star = stars(link_forest(fps.select("fp"), radius, blocks, block_rows))
    star = star.union(star.select(F.col("v"), F.col("v")).distinct()).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    least = star.join(fps, "fp").groupBy("root").agg(F.min("first").alias("least"))
    linked = star.join(least, "root").withColumn("linked", F.lit(True))
    classes = fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return docs, settled(classes)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, fingerprint (16 lowercase hex digits), component_id: the least id
    that links of at most `radius` (4) differing bits reach.

    A null or empty text has fingerprint 0 and links like any other. Null ids are not
    least, unless a component has no other id: then its component_id is null. Repeated
    rows are in one component. An empty table gives no row. Other columns are ignored.
    """
    docs, classes = _classes(df, id_col, text_col, **options)
    return docs.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes_of=_classes, marks=fingerprints, **options) -> DataFrame:
    """`df`, with all its columns, cut to one row of each group of near-duplicates: a row
    with the group's least id (null only where all are).

    Groups are those of `near_duplicates`, or of another pair of functions like its own:
    null and empty texts are alike, texts may have any length. A row whose id is unique is
    kept or not by its id. Rows of an id that is null or not unique are compared: of
    those of one group, the one that is least as JSON stays. An empty table gives no row.

    Ids that do not decide for themselves to stay (those dropped, null or repeated) go to
    a filter of bounded size; a row that it does not let through stays where it is. Only
    the others, with their texts, are shuffled to their ids.
    """
    docs, classes = classes_of(df, id_col, text_col, **options)
    heads = docs.join(classes, "fp").select("id", F.expr("id <=> component_id").alias("head"))
    per_id = heads.groupBy("id").agg(F.count("*").alias("n"), F.max("head").alias("head"))
    kind = F.when(~F.col("head"), "none").when(F.col("id").isNull() | (F.col("n") > 1), "some").otherwise("all")
    others = settled(per_id.select("id", kind.alias("kind")).where("kind <> 'all'"))
    maybe, kept = parted(df, F.col(id_col), others.select("id"))
    # Next to its texts a partition's ids are few, so they are hashed and the texts not sorted.
    kept = kept.union(maybe.join(others.hint("shuffle_hash"), F.col(id_col).eqNullSafe(others["id"]), "left_anti"))
    some = others.where("kind = 'some'")
    if some.isEmpty():
        return kept
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = maybe.join(some, F.col(id_col).eqNullSafe(some["id"]), "left_semi").select(F.struct(columns).alias("row"), F.col(text_col).alias("text"))
    rows = marks(rows, "row", "text").join(classes, "fp").where(F.col(f"row.`{id_col}`").eqNullSafe(F.col("component_id")))
    first = rows.groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.union(first.select([F.col(f"row.`{c}`").alias(c) for c in df.columns]))
