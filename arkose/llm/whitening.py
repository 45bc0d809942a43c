"""Whitening of vectors by a tiled covariance.

Dimensions are cut into column blocks; a pair of column blocks is a tile of the covariance.
Rows are cut into row blocks. Each row block's column blocks are shuffled to the tiles
they belong to, multiplied there pair by pair and added up along the row blocks; the sums
of a tile's parts are its entries. The tiles together are one matrix of dimensions by
dimensions, whatever the number of rows, whose eigenvectors the driver finds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arkose.llm.common import forget, fresh, mapped, settled
from arkose.shipping import shipped

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Dimensions of a column block, and rows of a row block at most.
COLUMN_BLOCK, ROW_BLOCK = 16, 4096
#: A matrix of this many dimensions (8 bytes an entry) still fits in the driver.
MOST_DIMENSIONS = 8192
#: Eigenvalues up to this share of the largest, times the dimensions, are rounding.
ROUNDING = 1e-12


class Model(NamedTuple):
    """Of the fit list: rows, sums by dimension (exact), falling eigenvalues, unit
    eigenvectors as columns, the trace of the covariance, and how far the whitened fit
    list's covariance is from the identity at most."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(df: DataFrame, vector_col: str) -> tuple[DataFrame, str]:
    """`df` without rows whose vector is null, empty or holds null or non-finite entries, and
    a column (its name comes second): floor(SCALE * entry) + SHIFT as longs. Entries of 2^56
    and beyond are an error."""
    v, x = F.col(f"`{vector_col}`"), fresh(df, "x")
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    entry = lambda e: F.when(F.abs(e.cast("double")) < float(1 << 56), F.floor(F.lit(float(SCALE)) * e.cast("double"))).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long")) + F.lit(SHIFT)
    return df.where(sound).withColumn(x, F.transform(v, entry)), x


def _blocks(batches, dims: int):
    """The vectors of each batch as matrices of at most ROW_BLOCK rows."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for a in range(0, len(flat), ROW_BLOCK):
            yield flat[a : a + ROW_BLOCK]


@shipped
def column_sums(fit: DataFrame, dims: int) -> np.ndarray:
    """Sums of the vectors' dimensions: one row of sums from each task, added up by Spark.
    Longs are added exactly, as decimals between tasks."""
    kind = fit.schema[0].dataType.elementType
    exact = isinstance(kind, T.LongType)

    def run(batches):
        total = [0] * dims if exact else np.zeros(dims)
        for m in _blocks(batches, dims):
            part = m.astype(object).sum(0) if exact and np.abs(m).max() > (1 << 62) // ROW_BLOCK else m.sum(0)
            total = [t + int(p) for t, p in zip(total, part)] if exact else total + part
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(map(str, total)) if exact else total)], names=["i", "s"])

    rows = fit.mapInArrow(run, f"i int, s {'string' if exact else 'double'}")
    sums = rows.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)") if exact else F.col("s")).alias("s")).orderBy("i")
    return np.array([int(r.s) if exact else r.s for r in sums.collect()], object if exact else float)


@shipped
def tiled_scatter(fit: DataFrame, whole: np.ndarray, rest: np.ndarray, width: int = COLUMN_BLOCK) -> np.ndarray:
    """Of the vectors v (the only column of `fit`) the sum of (v - c)(v - c)^T, c being
    whole + rest: the whole part is taken off before entries travel, the rest before they
    are multiplied, so nothing is lost to large common offsets.

    A row block's column block goes to the tiles of its row and column of tiles, so each
    entry is shuffled once for each column block. Parts of a tile are added up in the
    order of their row blocks, and the parts of all tasks in the order of the tasks."""
    dims = len(rest)
    edges = [*range(0, dims, width), dims]
    count = len(edges) - 1

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for m in _blocks(batches, dims):
            m = m - whole
            cells = [np.ascontiguousarray(_narrow(m[:, a:b])) for a, b in zip(edges, edges[1:])]
            pairs = [(min(i, j), max(i, j), i, cells[i]) for i in range(count) for j in range(count)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int32()),
                    pa.array([p[1] for p in pairs], pa.int32()),
                    pa.array([number] * len(pairs), pa.int64()),
                    pa.array([p[2] for p in pairs], pa.int32()),
                    pa.array([p[3].dtype.str for p in pairs]),
                    pa.array([p[3].tobytes() for p in pairs], pa.binary()),
                ],
                names=["i", "j", "block", "mine", "kind", "data"],
            )
            number += 1

    def multiply(batches):
        at, total, left = None, None, None
        for batch in batches:
            for i, j, block, mine, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and at != (i, j):
                    yield _part(at, total)
                    total = None
                at = (i, j)
                cell = np.frombuffer(data, kind).reshape(-1, edges[mine + 1] - edges[mine]) - rest[edges[mine] : edges[mine + 1]]
                if i == j:
                    product = cell.T @ cell
                elif left is None or left[0] != block:
                    left = (block, cell)
                    continue
                else:
                    product = left[1].T @ cell
                    left = None
                total = product if total is None else total + product
        if total is not None:
            yield _part(at, total)

    def _part(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "data"])

    def add(batches):
        at, total = None, None
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if at is not None and at != (i, j):
                    yield _part(at, total)
                    total = None
                at, part = (i, j), np.frombuffer(data)
                total = part if total is None else total + part
        if total is not None:
            yield _part(at, total)

    cells = fit.mapInArrow(cut, "i int, j int, block long, mine int, kind string, data binary")
    by = ["i", "j", "block"]
    parts = cells.repartition(*by).sortWithinPartitions(*by, "mine").mapInArrow(multiply, "i int, j int, data binary")
    parts = settled(parts.withColumn("task", F.spark_partition_id()))
    tiles = parts.repartition("i", "j").sortWithinPartitions("i", "j", "task").select("i", "j", "data").mapInArrow(add, "i int, j int, data binary")
    out = np.zeros((dims, dims))
    for r in tiles.collect():  # dims * dims numbers together
        (a, b), (c, d) = edges[r.i : r.i + 2], edges[r.j : r.j + 2]
        tile = np.frombuffer(bytes(r.data)).reshape(b - a, d - c)
        out[a:b, c:d], out[c:d, a:b] = tile, tile.T
    forget(parts)
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    if m.dtype != np.int64:
        return m
    most = max(-int(m.min()), int(m.max()) + 1) if m.size else 0
    return m.astype(next(k for k, bits in ((np.int8, 7), (np.int16, 15), (np.int32, 31), (np.int64, 63)) if most <= 1 << bits))


def _centre(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sums / n as whole numbers and the rests below 1."""
    return np.array([int(s) // n for s in sums], np.int64), np.array([(int(s) % n) / n for s in sums])


@shipped
def train(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, width: int = COLUMN_BLOCK) -> Model | None:
    """The whitening of the vectors of `df`, each distinct one of whole numbers counted once;
    None if there is none.

    Of vectors of several lengths only those of the most frequent length (of ties the
    longest) take part. A component whose eigenvalue is not above rounding is left out, so
    few or flat vectors have fewer components than asked for, or none.
    """
    vectors, x = whole_vectors(df.select(F.col(f"`{vector_col}`").alias("v")), "v")
    fit = settled(vectors.select(x).distinct())
    lengths = fit.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        forget(fit)
        return None
    dims, n = lengths["d"], lengths["n"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"a matrix of {dims} by {dims} does not fit in the driver; {MOST_DIMENSIONS} dimensions do")
    rows = fit.where(F.size(x) == dims)
    sums = column_sums(rows, dims)
    whole, rest = _centre(sums, n)
    covariance = tiled_scatter(rows, whole, rest, width) / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    order = order[values[order] > max(values[-1], 0) * dims * ROUNDING]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    model = Model(n, sums, values, axes, float(np.trace(covariance)), 0.0)
    if len(order):
        white = settled(_projected(rows, model, x).select("whitened"))
        mean = column_sums(white, len(order)) / n
        scatter = tiled_scatter(white, np.zeros(len(order)), mean, width)
        model = model._replace(identity_error=float(np.abs(scatter / n - np.eye(len(order))).max()))
        forget(white)
    forget(fit)
    return model


def _projected(df: DataFrame, model: Model, x: str) -> DataFrame:
    """`df` without its last column x, and whitened and deviation of its vectors."""
    n, sums, values, vectors = model[:4]
    (whole, rest), axes, k = _centre(sums, n), vectors / np.sqrt(values), len(values)
    over = np.array([int(s) % n for s in sums], object)

    def run(batches):
        for batch in batches:
            m = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)) - whole
            white = pa.array(((m - rest) @ axes).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * k), white)
            # the sum of (n x - S)^2 with x = whole + m and S = n whole + over, in Python's whole numbers
            small = len(m) == 0 or int(np.abs(m).max()) ** 2 * len(sums) < 1 << 62 and int(np.abs(m).max()) * n * len(sums) < 1 << 62
            d = m if small else m.astype(object)
            square, cross = (d * d).sum(1), d @ (over.astype(np.int64) if small else over)
            exact = [n * n * int(a) - 2 * n * int(b) + int((over * over).sum()) for a, b in zip(square, cross)]
            far = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, far], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    others = [c for c in df.columns if c != x]
    fields = [*[df.schema[c] for c in others], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    return mapped(df.select(*[F.col(f"`{c}`") for c in others], F.col(x)), run, T.StructType(fields))


@shipped
def whiten(df: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of `df` whose vector is sound and has the model's length: id, whitened (an
    array, one entry a component) and deviation, the sum over dimensions of
    (n * x - sum)^2, exact (null where a long does not hold it). Without a model no row.
    Null and repeated ids are rows like others; other columns are ignored."""
    rows, x = whole_vectors(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")), "v")
    if model is None:
        model = Model(1, np.zeros(1, object), np.empty(0), np.empty((1, 0)), 0.0, 0.0)
        rows = rows.where("false")
    rows = rows.where(F.size(x) == len(model.sums)).select("id", x)
    return _projected(rows, model, x).withColumnRenamed("id", id_col)


def components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """`whiten` with a model of the same rows, a row for each component from 1: id,
    component, n, deviation, whitened, explained (share of the trace), identity_error.

    Rows without a sound vector are left out (`whole_vectors`). Equal vectors count once
    in the model and are all whitened. Where no component is above rounding, and for an
    empty table, there is no row."""
    model = train(df, vector_col, count)
    rows = whiten(df, model, id_col, vector_col)
    values = [] if model is None else (model.values / model.trace).tolist()
    number, error = (0, 0.0) if model is None else (model.n, model.identity_error)
    explained = F.element_at(F.array(*map(F.lit, values or [0.0])), F.col("component"))
    out = rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return out.select(id_col, "component", F.lit(number).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
