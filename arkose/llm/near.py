"""Pairs of texts whose sets of word 5-shingles have a Jaccard similarity of 0.8 or more.

All such pairs are found. In one order of all shingles, two such sets share one of the
first n - ceil(0.8 n) + 1 of each (their prefixes), so texts that share a shingle of their
prefixes are candidates. The order puts shingles that are common in a bounded sample last;
the sample only saves work. A candidate passes if sizes and places leave 0.8 possible and
if parity sketches (about one bit a shingle, each flipped by the shingles that hash to
it) do not differ in more bits than the sets could; these bounds never drop a pair. What
passes is compared by the texts' own shingles. A first turn links each set to the next
that passes; the second compares all pairs that are still in different groups.

What is shuffled of a prefix is 16 bytes a shingle, in blocks by hash; rows that have no
possible partner end there. Sets meet as compressed texts, and only for pairs that pass
all bounds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.llm import simhash
from arkose.llm.common import forget, settled, slices, typed
from arkose.operators.graphs import stars
from arkose.shipping import shipped

SEED, SHINGLE = 42, 5
#: Similar: 4 of 5 parts, as whole numbers (0.8).
NUM, DEN = 4, 5
#: Bounds of the sample from which common shingles are known.
SAMPLE_DOCS, COMMON, LEAST_COMMON = 8192, 1 << 17, 3
#: Bits of a sketch at least: of few shingles, sets below 0.8 shall differ in enough bits.
LEAST_BITS = 512
#: Bits of the filter of ids whose texts are compared.
FILTER_BITS = 26
#: Groups of up to LOOK rows are searched for rows with a possible partner. Those of up to
#: NEXT such rows are solved by sizes and places alone, larger ones with sketches.
LOOK, NEXT = 64, 8
#: Rows of a bucket, as planned; rows a task keeps before it hands them on.
BUCKET_ROWS, FLUSH_ROWS = 1 << 19, 1 << 18


def normal(text: str | None) -> bytes:
    """The words, A-Z in lower case (other letters stay), with single spaces."""
    return b" ".join((text or "").encode().lower().split())  # bytes: ASCII white space only


def shingles(data: bytes) -> np.ndarray:
    """The sorted distinct hashes (XXH64) of the word 5-shingles of a normal text; of the
    whole text, if it has fewer words; none without words."""
    if not data:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < SHINGLE:
        return np.array([digest(data, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) + 1 - SHINGLE] + 1).tolist()]
    ends = [*gaps[SHINGLE - 1 :].tolist(), len(data)]
    return np.unique(np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def node(hashes: np.ndarray) -> int:
    """One signed long for equal sets."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the hashes on each of 2^k places, a bit or more for each hash."""
    bits = max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing bits of sketches; a longer one is folded to the other's length."""
    out = np.zeros(len(a), np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        shapes.setdefault((len(x), len(y)), []).append(i)
    for (m, n), at in shapes.items():
        k = min(m, n)
        parts = [np.frombuffer(b"".join([s[i] for i in at]), np.uint64).reshape(len(at), -1, k // 8) for s in (a, b)]
        x, y = (np.bitwise_xor.reduce(p, axis=1) for p in parts)
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that a similar set shares one of, in order (rare before common ones),
    and their counts in the sample."""
    n = len(hashes)
    rank = np.zeros(n, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    first = np.lexsort((hashes, rank))[: n - -(-NUM * n // DEN) + 1] if n else np.empty(0, np.int64)
    return hashes[first], rank[first]


def similar(common: int, a: int, b: int) -> bool:
    return DEN * common >= NUM * (a + b - common)


def placed(size_a, pos_a, size_b, pos_b, first: bool = False) -> np.ndarray:
    """Pairs that may be similar by the sizes of two sets and the places of one shingle.
    With `first`, only if no shingle before it is in both: each similar pair passes at the
    first shingle of both, and need not be listed at the others."""
    least = -(-NUM * (size_a + size_b) // (NUM + DEN))  # of common shingles
    if first:
        return np.minimum(size_a - pos_a, size_b - pos_b) >= least
    # At most so many common ones lie before the place in both, and so many from it on.
    return (DEN * np.minimum(size_a, size_b) >= NUM * np.maximum(size_a, size_b)) & (np.minimum(pos_a, pos_b) + np.minimum(size_a - pos_a, size_b - pos_b) >= least)


def close(size_a, sketch_a, size_b, sketch_b) -> np.ndarray:
    """Pairs that may be similar by their sketches: these differ in no more bits than the
    sets in shingles."""
    both = size_a + size_b
    return distances(sketch_a, sketch_b) <= both - 2 * -(-NUM * both // (NUM + DEN))


@shipped
def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp (the node of its set), size, bits (its SimHash) and sketch."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingles(normal(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(np.array([simhash.voted(x) for x in sets], np.uint64).view(np.int64)), pa.array(map(sketch, sets), pa.binary())], names=["id", "fp", "size", "bits", "sketch"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, typed(source, "id", "fp long, size int, bits long, sketch binary")).withColumnRenamed("id", id_col)


@shipped
def common_shingles(df: DataFrame, rows: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of shingles that several texts of a bounded sample have."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(normal(text)).view(np.int64))], names=["h"])

    sample = df.select(text_col).sample(min(1.0, SAMPLE_DOCS / max(rows, 1)), seed=SEED)
    found = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= LEAST_COMMON).orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _planes(bucket: int, h: np.ndarray, fp: np.ndarray, pos: np.ndarray, size: np.ndarray) -> bytes:
    """Rows column by column; the high halves of places and sizes are mostly zeros. In a
    bucket from 0 on, the high half of h is the bucket and is left out."""
    small = [x.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes() for x in (pos, size)]
    return b"".join([h.astype("<u4" if bucket >= 0 else "<u8").tobytes(), fp.astype("<i8").tobytes(), *small])


def _rows(bucket: int, data: bytes) -> list[np.ndarray]:
    w = 4 if bucket >= 0 else 8
    n = len(data) // (w + 16)
    h, fp = np.frombuffer(data, f"<u{w}", n).astype(np.int64), np.frombuffer(data, "<i8", n, w * n)
    pos, size = (np.ascontiguousarray(np.frombuffer(data, "<u2", 2 * n, (w + at) * n).reshape(2, n).T).view("<u4").ravel().astype(np.int64) for at in (8, 12))
    return [h | max(bucket, 0) << 32, fp, pos, size]


def prefixes(df: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int, hot: int, text_col: str = "text") -> DataFrame:
    """Rows (bucket, data): the prefixes' (h, fp, pos, size) in blocks by their hash, of
    which h has the bucket and 32 bits more; a task gives those of equal sets about once. A shingle with `hot` or more texts of the
    sample is not gathered: its rows go to buckets below 0, whatever their hash."""

    def run(batches):
        seen: set = set()
        parts: list = []
        held, turn = 0, 0

        def flush():
            nonlocal parts, held, turn
            h, rank, fp, pos, size = (np.concatenate(x) for x in zip(*parts))
            turn += 1
            own = (h % np.uint64(buckets)).astype(np.int64)
            h = own << 32 | (h >> np.uint64(32)).astype(np.int64)
            bucket = np.where(rank >= hot, -1 - turn % buckets, own)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cuts)
            parts, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups], pa.int64()), pa.array([_planes(int(bucket[g[0]]), h[g], fp[g], pos[g], size[g]) for g in groups], pa.binary())], names=["bucket", "data"])

        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                hashes = shingles(normal(text))
                k = node(hashes)
                if k in seen or not len(hashes):
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(k)
                first, rank = prefix(hashes, *common)
                n = len(first)
                parts.append((first, rank, np.full(n, k, np.int64), np.arange(n), np.full(n, len(hashes), np.int64)))
                held += n
                if held >= FLUSH_ROWS:
                    yield flush()
        if parts:
            yield flush()

    return df.select(text_col).mapInArrow(run, "bucket long, data binary")


def shared(blocks: DataFrame) -> DataFrame:
    """Rows (h, fp, pos, size, n, next), each once, of the prefixes' rows that by sizes and
    places may have a partner of the same h. n is the number of such rows of the h, and
    next, where n is at most NEXT, the next one that is a possible partner. Rows of a hot
    h are given as they are, with n = 0."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket < 0:
                    h, fp, pos, size = _rows(bucket, data)
                    yield table(h, fp, pos, size, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool))
                    continue
                if bucket != now and held:
                    yield useful(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = bucket
                held.append(_rows(bucket, data))
        if held:
            yield useful(*(np.concatenate(x) for x in zip(*held)))

    def table(h, fp, pos, size, n, following, has):
        cols = [pa.array(h), pa.array(fp), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(following, mask=~has)]
        return pa.RecordBatch.from_arrays(cols, names=["h", "fp", "pos", "size", "n", "next"])

    def useful(h, fp, pos, size):
        order = np.lexsort((fp, h))
        h, fp, pos, size = (x[order] for x in (h, fp, pos, size))
        new = np.r_[True, (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])]
        h, fp, pos, size = (x[new] for x in (h, fp, pos, size))
        end = np.searchsorted(h, h, "right")
        keep = end - np.searchsorted(h, h) > LOOK
        following, has = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        a = np.flatnonzero(~keep)
        for step in range(1, LOOK):
            a = a[a + step < end[a]]
            if not len(a):
                break
            b = a + step
            ok = placed(size[a], pos[a], size[b], pos[b], True)
            keep[a[ok]] = keep[b[ok]] = True
            first = a[ok & ~has[a]]
            following[first], has[first] = fp[first + step], True
        h, fp, pos, size, following, has = (x[keep] for x in (h, fp, pos, size, following, has))
        n = np.searchsorted(h, h, "right") - np.searchsorted(h, h)
        return table(h, fp, pos, size, n, following, has & (n <= NEXT))

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "h long, fp long, pos int, size int, n int, next long")


def _ordered(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])


def _runs(batches, keys: int):
    """Columns and group numbers of whole groups, which are runs of equal first `keys`
    columns; the last group of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        cols = [batch.column(c) for c in range(batch.num_columns)]
        cols = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy() for c in cols]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        group = np.r_[False, np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)].cumsum()
        cut = int(np.searchsorted(group, group[-1]))
        rest = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols], group[:cut]
    if rest is not None and len(rest[0]):
        yield rest, np.zeros(len(rest[0]), np.int64)


def small_groups(rows: DataFrame) -> DataFrame:
    """From rows (h, fp, pos, size, root) of groups of at most NEXT: pairs (u, v) of
    different roots that may be similar by sizes and places."""

    def solve(batches):
        for (_, fp, pos, size, root), group in _runs(batches, 1):
            pos, size = pos.astype(np.int64), size.astype(np.int64)
            end, a, u, v = np.searchsorted(group, group, "right"), np.arange(len(group)), [], []
            step = 1
            while True:
                a = a[a + step < end[a]]
                if not len(a):
                    break
                x = a[root[a] != root[a + step]]
                x = x[placed(size[x], pos[x], size[x + step], pos[x + step], True)]
                u.append(fp[x]), v.append(fp[x + step])
                step += 1
            if u:
                yield _ordered(np.concatenate(u), np.concatenate(v))

    rows = rows.select("h", "fp", "pos", "size", "root").repartition("h").sortWithinPartitions("h", "fp")
    return rows.mapInArrow(solve, "u long, v long").distinct()


def large_groups(rows: DataFrame, fps: DataFrame, every: bool, block_rows: int = 1024) -> DataFrame:
    """From rows (h, fp, pos, size, root) of groups of any size: pairs (u, v) of different
    roots that share an h and pass, sketches included. All of them, or for each row the
    next in its block only. Blocks of a group meet two and two, so none must fit in a
    task."""
    full = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    rows = rows.join(settled(full.select("h", "n")), "h").withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    rows = rows.join(fps.select("fp", "sketch"), "fp")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "pos", "size", "root", "sketch")
    rows = rows.withColumn("side", (F.col("part") > F.col("i")).cast("byte"))
    by = ["h", "i", "j"]

    def solve(batches):
        for (_, i, j, fp, pos, size, root, side, marks), group in _runs(batches, 3):
            pos, size = pos.astype(np.int64), size.astype(np.int64)
            end, a, u, v = np.searchsorted(group, group, "right"), np.arange(len(group)), [], []
            step = 1
            while True:
                a = a[a + step < end[a]]
                if not len(a):
                    break
                # a block with itself (i = j), or rows of one block with those of another
                x = a[(root[a] != root[a + step]) & ((i[a] == j[a]) | (side[a] != side[a + step]))]
                x = x[placed(size[x], pos[x], size[x + step], pos[x + step], True)]
                x = x[close(size[x], marks[x].tolist(), size[x + step], marks[x + step].tolist())]
                u.append(fp[x]), v.append(fp[x + step])
                if not every:
                    a = a[~np.isin(a, x, assume_unique=True)]
                step += 1
            if u:
                yield _ordered(np.concatenate(u), np.concatenate(v))

    rows = rows.select(*by, "fp", "pos", "size", "root", "side", "sketch").repartition(*by).sortWithinPartitions(*by, "fp")
    return rows.mapInArrow(solve, "u long, v long").distinct()


def simhash_pairs(fps: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Pairs (u, v) of sets (fp, bits) whose SimHashes are equal or differ in at most 4
    bits. A set is paired with few others, not with all: with the least of its SimHash, and
    that with the first within 4 bits in each block of each table."""
    heads = settled(fps.groupBy("bits").agg(F.min("fp").alias("head")))
    equal = fps.join(heads, "bits").where("fp <> head").select("head", "fp")
    links = settled(simhash.link_forest(heads.select(F.col("bits").alias("fp")), block_rows=block_rows, direct=True).distinct())
    one = links.join(heads.select(F.col("bits").alias("u"), F.col("head").alias("a")), "u")
    both = one.join(heads.select(F.col("bits").alias("v"), F.col("head").alias("b")), "v")
    pairs = settled(equal.toDF("a", "b").union(both.select("a", "b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    forget(heads, links)
    return pairs


def sifted(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """Of pairs (u, v), each once, those that may be similar by their sketches."""

    def run(batches):
        for batch in batches:
            a, x, b, y = (batch.column(c) for c in range(2, 6))
            ok = close(a.to_numpy().astype(np.int64), x.to_pylist(), b.to_numpy().astype(np.int64), y.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))

    one = pairs.join(fps.select(F.col("fp").alias("u"), F.col("size").alias("a"), F.col("sketch").alias("x")), "u")
    both = one.join(fps.select(F.col("fp").alias("v"), F.col("size").alias("b"), F.col("sketch").alias("y")), "v")
    return both.select("u", "v", "a", "x", "b", "y").mapInArrow(run, "u long, v long")


def verified(df: DataFrame, pairs: DataFrame, fps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (u, v), those whose sets are similar. Only texts of these pairs leave their
    tasks, compressed and one for each set: a filter of bounded size over their ids goes
    there, and what it lets through is joined. The result is a written table."""
    wanted = settled(fps.join(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi").select("fp", "first"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    bit = F.crc32(name(F.col("first"))) % (1 << FILTER_BITS)
    words = wanted.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    where, bits = words["w"].to_numpy(), words["bits"].to_numpy().view(np.uint64)
    order = np.argsort(where)
    where, bits = where[order], bits[order]

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            keys, texts = [], []
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                b = zlib.crc32(id_.encode()) % (1 << FILTER_BITS)
                at = int(np.searchsorted(where, b >> 6))
                if at < len(where) and where[at] == b >> 6 and int(bits[at]) >> (b & 63) & 1:
                    data = normal(batch.column(1)[i].as_py())
                    keys.append(node(shingles(data))), texts.append(zip_.compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["fp", "data"])

    def compare(batches):
        unzip, known = zstandard.ZstdDecompressor(), {}

        def of(fp, data):
            if fp not in known:
                if len(known) >= 64:
                    known.clear()
                known[fp] = shingles(unzip.decompress(data))
            return known[fp]

        for batch in batches:
            ok = []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in range(4))):
                a, b = of(u, a), of(v, b)
                ok.append(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    found = df.select(name(F.col(id_col)).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "fp long, data binary")
    texts = settled(found.join(wanted, "fp", "left_semi"), "none")
    one = pairs.join(texts.select(F.col("fp").alias("u"), F.col("data").alias("a")), "u")
    both = one.join(texts.select(F.col("fp").alias("v"), F.col("data").alias("b")), "v")
    near = settled(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long").distinct())
    forget(wanted, texts)
    return near


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1024, hot_rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), and for each distinct set (fp, root, component_id): the least fp and
    the least id (null if there is none) of those that chains of similar pairs reach.

    Null and empty texts have the empty set and form one class. Texts may have any
    length. Null ids are least only where a class has no other; repeated rows are in one
    class; an empty table gives no row; other columns are ignored. A shingle that, by the
    sample, more than `hot_rows` texts have is never gathered in one task.
    """
    spark = df.sparkSession
    docs = settled(marked(df, id_col, text_col).withColumnRenamed(id_col, "id"))
    fps = settled(docs.groupBy("fp").agg(F.min("id").alias("first"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min("sketch").alias("sketch")))
    n, total = docs.agg(F.count("*"), F.sum("size")).first()
    common = common_shingles(df, n, text_col)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // (5 * BUCKET_ROWS)))
    hot = max(1, -(-hot_rows * min(SAMPLE_DOCS, n) // max(n, 1)))
    rows = settled(shared(prefixes(df, common, buckets, hot, text_col)))
    few = rows.where(F.col("n").between(2, NEXT))
    many = settled(rows.where(~F.col("n").between(2, NEXT)).select("h", "fp", "pos", "size").distinct())
    crowded = not many.isEmpty()
    star, tried = spark.createDataFrame([], "fp long, root long"), []

    def rooted(d):
        return d.join(star, "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def turn(pairs):
        """`star` with the links that are found among pairs not yet tried."""
        for before in tried:
            pairs = pairs.join(before, ["u", "v"], "left_anti")
        tried.append(settled(pairs))
        passing = settled(sifted(tried[-1], fps))
        if passing.isEmpty():
            return star
        found = verified(df, passing, fps, id_col, text_col)
        joined = stars(star.toDF("u", "v").union(found)).toDF("fp", "root")
        forget(passing, found)
        return joined

    star = turn(simhash_pairs(fps, block_rows))
    following = few.where("next is not null").select(F.least("fp", "next").alias("u"), F.greatest("fp", "next").alias("v")).distinct()
    one = following.join(star.toDF("u", "a"), "u", "left").join(star.toDF("v", "b"), "v", "left")
    pairs = one.where("coalesce(a, u) <> coalesce(b, v)").select("u", "v")
    if crowded:
        pairs = pairs.union(large_groups(rooted(many), fps, False, block_rows)).distinct()
    star = turn(pairs)
    pairs = small_groups(rooted(few))
    if crowded:
        pairs = pairs.union(large_groups(rooted(many), fps, True, block_rows)).distinct()
    star = turn(pairs)
    star = star.union(star.select(F.col("root"), F.col("root")).distinct())
    least = star.join(fps.select("fp", "first"), "fp").groupBy("root").agg(F.min("first").alias("least"))
    linked = star.join(least, "root").withColumn("linked", F.lit(True))
    found = fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    found = settled(found)
    forget(fps, rows, many, *tried)
    return docs.select("id", "fp"), found
