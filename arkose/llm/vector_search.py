"""Exact inner-product top-k as a Voronoi join of queries and data.

Rows go to the nearest of a fixed number of pivots. Cell summaries (rows, queries,
largest distance from the pivot) and a bounded sample give each query a lower bound of
its k-th best score, and from q.x <= q.p + |q| |x - p| follows how far from a pivot p a
row must be to reach it. The least of these distances over a group of queries is the
group's bound for that cell: a row is sent to a group only if it lies at least so far
out. Groups and the rows sent to them are cut into blocks, solved apart, and the blocks'
best k are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkose.llm.common import settled
from arkose.shipping import shipped

#: Bounds of what is collected and broadcast: rows sampled for pivots and first bounds,
#: pivots, and query groups with a bound for each pivot.
SAMPLE, PIVOTS, GROUPS = 2048, 32, 4096
#: Queries and rows that meet in a task; so many of the queries are scored at once.
QUERY_BLOCK, DATA_BLOCK, AT_ONCE = 32768, 8192, 512
#: Cells of fewer queries share a group with the next ones.
LEAST_QUERIES = 512
_LONG = (1 << 63) - 1


def scaled(vectors: pa.Array, scale: float) -> list:
    """floor(scale * x) of each vector as int64 numbers; None for a vector that is null,
    holds a null or a non-finite number, or leaves the range of long."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    flat, ends = vectors.values, vectors.offsets.to_numpy()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(scale * x)
    good = np.isfinite(x) & (np.abs(y) < 2.0**63)
    y = np.where(good, y, 0).astype(np.int64)
    whole = np.r_[0, np.cumsum(~good)]
    ok = (whole[ends[1:]] == whole[ends[:-1]]) & ~np.asarray(vectors.is_null())
    return [y[a:b] if k else None for a, b, k in zip(ends[:-1].tolist(), ends[1:].tolist(), ok.tolist())]


def narrow(v: np.ndarray, most: int) -> bytes:
    """The numbers in the fewest of 2, 4 or 8 bytes that hold -most to most."""
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _matrix(raw: list[bytes], dims, dim: int) -> np.ndarray:
    """Vectors of `dims` numbers each (of 2, 4 or 8 bytes) as rows of int64, shorter ones
    filled with zeros."""
    out = np.zeros((len(raw), dim), np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (r, d) in enumerate(zip(raw, dims)):
        if d:
            shapes.setdefault((len(r) // d, d), []).append(i)
    for (w, d), at in shapes.items():
        out[at, :d] = np.frombuffer(b"".join([raw[i] for i in at]), f"<i{w}").reshape(len(at), d)
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of long they end there."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; ids ascend."""
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= cut)
    else:
        at = np.arange(len(s))
    return at[np.argsort(-s[at].astype(np.float64) if abs(int(s[at].min(initial=0))) < 2**53 else -s[at].astype(object), kind="stable")][:k]


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows far from each other, moved to the means of what is nearest to them."""
    x = x.astype(np.float64)
    at, far = [0], None
    for _ in range(min(n, len(x)) - 1):
        d = ((x - x[at[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        at.append(int(far.argmax()))
    p = x[at]
    for _ in range(4):
        own = ((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)).argmin(1)
        p = np.stack([x[own == c].mean(0) if (own == c).any() else p[c] for c in range(len(p))])
    return p


@shipped
def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score.

    Queries are the rows where `is_query` holds, candidates all rows but those of the
    query's own id. A row whose id or vector is null, or whose vector holds a null or
    non-finite number (or one beyond the range of long, scaled), takes no part. Rows of
    one id count once, with their best score. A shorter vector is as if filled with
    zeros. Ties go to the smaller id. No queries or no candidates give no row. Other
    columns are ignored. A row is sent once to each block of queries it can matter to,
    with its numbers in the fewest bytes that hold all of the table.
    """
    spark = df.sparkSession

    def prepare(batches):
        for batch in batches:
            vectors = scaled(batch.column(1), scale)
            keep = [i for i, v in enumerate(vectors) if v is not None]
            to = pa.array(keep, pa.int64())
            most = [max(int(v.max()), -int(v.min())) if len(v) else 0 for v in map(vectors.__getitem__, keep)]
            raw = [narrow(vectors[i], m) for i, m in zip(keep, most)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(to), pa.array(raw, pa.binary()), pa.array([len(vectors[i]) for i in keep], pa.int32()), pa.array([min(m, _LONG) for m in most], pa.int64()), batch.column(2).take(to)], names=["id", "vec", "dim", "most", "query"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("id is not null")
    rows = settled(source.mapInArrow(prepare, "id long, vec binary, dim int, most long, query boolean"))
    out = "query_id long, vec_id long, score long"
    dim, most = rows.agg(F.max("dim"), F.max("most")).first()
    dim, most = dim or 0, most or 0
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("id", "vec", "dim").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    known, known_ids = _matrix([bytes(r.vec) for r in sample], [r.dim for r in sample], dim), np.array([r.id for r in sample])
    pivots = _pivots(known, PIVOTS)
    shared = spark.sparkContext.broadcast((known, known_ids, pivots))

    def assign(batches):
        """Adds the cell, the distance from its pivot, and for a query how far from each
        pivot a row must be to get among its best k."""
        known, known_ids, pivots = shared.value
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), batch.column(2).to_pylist(), dim)
            y = x.astype(np.float64)
            d = np.sqrt(np.maximum(0, (y**2).sum(1)[:, None] - 2 * y @ pivots.T + (pivots**2).sum(1)))
            cell = d.argmin(1)
            far = np.sqrt(((y - pivots[cell]) ** 2).sum(1))
            ids, asks = batch.column(0).to_numpy(), np.flatnonzero(np.asarray(batch.column(3)))
            need: list = [None] * len(ids)
            for i in asks.tolist():
                least = _kth(scores(x[i : i + 1], known)[0], known_ids, ids[i], k)
                size = np.sqrt((y[i] ** 2).sum())
                need[i] = [-1.0] * len(pivots) if least is None or not size else ((least - pivots @ y[i]) / size * (1 - 1e-9) - 1e-6 * (1 + size)).tolist()
            even = pa.array([narrow(v, most) for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), even, batch.column(3), pa.array(cell, pa.int32()), pa.array(far, pa.float64()), pa.array(need, pa.list_(pa.float64()))], names=["id", "vec", "query", "cell", "far", "need"])

    placed = settled(rows.select("id", "vec", "dim", "query").mapInArrow(assign, "id long, vec binary, query boolean, cell int, far double, need array<double>"))
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("query").alias("asks"), F.max("far").alias("far")).collect()}
    first, parts, sizes = _groups({c: r.asks for c, r in cells.items()})
    table = lambda d: F.element_at(F.array(*[F.lit(int(d.get(c, 0))) for c in range(len(pivots))]), F.col("cell") + 1)
    asks = placed.where("query").withColumn("grp", table(first) + F.pmod(F.xxhash64(F.lit(1), "id"), table(parts)).cast("int"))
    need = np.full((len(sizes), len(pivots)), np.inf)
    bounds = asks.groupBy("grp").agg(F.count("*").alias("n"), *[F.min(F.col("need")[c]).alias(f"c{c}") for c in range(len(pivots))])
    for r in bounds.collect():  # at most GROUPS + PIVOTS rows
        sizes[r.grp] = r.n
        need[r.grp] = [r[f"c{c}"] for c in range(len(pivots))]
    sent = [sum(r.n for c, r in cells.items() if r.far >= need[g, c]) for g in range(len(sizes))]
    slices = [max(1, -(-int(n) // QUERY_BLOCK)) for n in sizes]
    blocks = [max(1, -(-n // DATA_BLOCK)) for n in sent]
    plan = spark.sparkContext.broadcast((need, np.array(slices)))

    def to_groups(batches):
        need, slices = plan.value
        rows = max(1, (1 << 20) // len(slices))  # so many rows meet all groups' bounds at once
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                near = batch.column(3).to_numpy()[:, None] >= need.T[batch.column(2).to_numpy()]
                row, grp = np.nonzero(near)
                for a in range(0, len(row), 1024):
                    r, g = row[a : a + 1024], grp[a : a + 1024]
                    for part in range(int(slices[g].max(initial=0))):  # the group's query blocks
                        keep = slices[g] > part
                        to = pa.array(r[keep])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(to), batch.column(1).take(to), pa.array(g[keep], pa.int32()), pa.array(np.full(len(to), part), pa.int32())], names=["id", "vec", "grp", "part"])

    block_of = F.element_at(F.array(*map(F.lit, blocks)), F.col("grp") + 1) if len(blocks) <= 64 else F.try_element_at(F.lit(blocks), F.col("grp") + 1)
    data = placed.select("id", "vec", "cell", "far").mapInArrow(to_groups, "id long, vec binary, grp int, part int")
    data = data.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), block_of).cast("int"))
    slice_of = F.element_at(F.array(*map(F.lit, slices)), F.col("grp") + 1) if len(slices) <= 64 else F.try_element_at(F.lit(slices), F.col("grp") + 1)
    asks = asks.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), slice_of).cast("int"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), (block_of - 1).cast("int")))).select("id", "vec", "grp", "part", "block")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q_out, v_out, s_out = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids, q_ids = right.column("id").to_numpy(), left.column("id").to_numpy()
            queries, x = (_matrix(t.column("vec").to_pylist(), [dim] * t.num_rows, dim) for t in (left, right))
            heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            each = ids[heads]
            for a in range(0, len(q_ids), AT_ONCE):
                some = scores(queries[a : a + AT_ONCE], x)
                if len(heads) < len(ids):
                    some = np.maximum.reduceat(some, heads, axis=1)
                for q, s in zip(q_ids[a : a + AT_ONCE], some):
                    own, those = np.searchsorted(each, q), each
                    if own < len(each) and each[own] == q:
                        s, those = np.delete(s, own), np.delete(each, own)
                    at = best(s, those, k)
                    q_out.append(np.full(len(at), q)), v_out.append(those[at]), s_out.append(s[at])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(q_out), "vec_id": cat(v_out), "score": cat(s_out)})

    by = ["grp", "part", "block"]
    found = asks.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve, out)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(s: np.ndarray, ids: np.ndarray, own: int, k: int):
    """The k-th best score among distinct other ids, or None: a bound from below."""
    s, ids = s[ids != own], ids[ids != own]
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((-s, ids))
        s, ids = s[order], ids[order]
        s = s[np.r_[True, ids[1:] != ids[:-1]]]
    return int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None


def _groups(asks: dict[int, int]) -> tuple[dict, dict, list[int]]:
    """Cells to query groups: (first group, number of groups) of each cell and a list
    with a 0 for each group. Cells of few queries next to each other share one; a large
    cell is split by a hash. At most GROUPS + PIVOTS groups, whatever the number of
    queries."""
    want = max(QUERY_BLOCK, -(-sum(asks.values()) // GROUPS))
    least = min(LEAST_QUERIES, want)
    first, parts, n, filled = {}, {}, 0, None
    for c in sorted(asks):
        if asks[c] > least:
            first[c], parts[c] = n, -(-asks[c] // want)
            n, filled = n + parts[c], None
        else:
            if filled is None or filled + asks[c] > least:
                n, filled = n + 1, 0
            first[c], parts[c], filled = n - 1, 1, filled + asks[c]
    return first, parts, [0] * max(1, n)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.e, c.e))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
