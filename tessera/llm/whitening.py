"""Operator 13: whitening of embeddings by a tiled covariance.

Vectors lie on a grid of integers, and each distinct one is fitted once.  Distinct
vectors are cut into row blocks, and those into column blocks, each a row of bytes;
a pair of column blocks is a tile of the covariance.  Column blocks are shuffled by their
row block, tile pairs are multiplied, and the products are summed a tile, within the task
first.  The tiles are assembled on the driver, whose memory follows the square of the
dimension alone, and decomposed there.

Entries are centred by the rounded mean before they are multiplied, so products and sums
are whole numbers and exact in any order; what the rounding left, half a unit at most, is taken
off exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from .shared import discard, materialize, table

#: Dimensions of a column block, distinct vectors of a row block.
TILE, BLOCK_ROWS = 32, 4096
#: Eigenvalues under this share of the largest count as none: the data do not vary there.
LEAST_SHARE = 1e-11
_WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64))
_WHOLE = pa.decimal128(38, 0)


def _pack_rows(x: np.ndarray) -> list[bytes]:
    """A row's integers in the narrowest type that holds them, after a byte that names it: equal rows have equal bytes."""
    top = np.maximum(x.max(1, initial=0), -(x.min(1, initial=0) + 1)).astype(np.uint64)
    width = np.select([top < 2**7, top < 2**15, top < 2**31], [1, 2, 4], 8)
    out: list = [None] * len(x)
    for w, kind in _WIDTHS:
        for k in np.flatnonzero(width == w).tolist():
            out[k] = bytes((w,)) + x[k].astype(kind).astype(f"<i{w}").tobytes()
    return out


def _unpack(column: pa.Array, dimension: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, f"<i{b[0]}", offset=1) for b in column.to_pylist()]).astype(np.int64).reshape(-1, dimension) if len(column) else np.zeros((0, dimension), np.int64)


def _grid(column: pa.Array, dimension: int, scale: float) -> np.ndarray:
    """floor(scale * entry) of each row; rows have been filtered, so all fit."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values).astype(np.int64).reshape(-1, dimension)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b, exact: in doubles while every sum is a whole number below 2**53, else in Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a)
    if most < 2**53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object).T @ b.astype(object)


def _wholes(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _WHOLE)


def _packed(dimension: int, scale: float):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pack_rows(_grid(batch.column(0), dimension, scale)), pa.binary())], ["x"])

    return run


def _sums(dimension: int):
    def run(batches):
        n, total = 0, np.zeros(dimension, object)
        for batch in batches:
            x = _unpack(batch.column(0), dimension)
            n, total = n + len(x), total + x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), _wholes(total)], ["dimension", "n", "total"])

    return run


def _cut(dimension: int, centre: np.ndarray):
    """Row blocks of the fitted vectors, cut into column blocks; the table is written, so a task that runs again cuts alike."""

    def run(batches):
        block, held, task = 0, [], TaskContext.get().partitionId() << 32

        def out(x):
            parts = [x[:, a : a + TILE] for a in range(0, dimension, TILE)]
            payload = [_pack_rows(p.reshape(1, -1))[0] for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([task + block] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([len(x)] * len(parts), pa.int32()), pa.array(payload, pa.binary())], ["row_block", "column_block", "rows", "entries"])

        for batch in batches:
            x = _unpack(batch.column(0), dimension) - centre
            for a in range(0, len(x), BLOCK_ROWS):
                held.append(x[a : a + BLOCK_ROWS])
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield out(np.concatenate(held))
                    block, held = block + 1, []
        if held and sum(map(len, held)):
            yield out(np.concatenate(held))

    return run


def _multiply(names: list[str]):
    """Products of pairs of column blocks, summed a tile within the task; a tile's row of TILE sums is a row."""

    def run(batches):
        tiles: dict[tuple[int, int], np.ndarray] = {}

        def out():
            for (i, j), sums in tiles.items():
                wide = np.zeros((TILE, TILE), object)
                wide[: sums.shape[0], : sums.shape[1]] = sums
                yield pa.RecordBatch.from_arrays([pa.array([i] * TILE, pa.int32()), pa.array([j] * TILE, pa.int32()), pa.array(range(TILE), pa.int32()), *[_wholes(wide[:, c]) for c in range(TILE)]], ["i", "j", "r", *names])

        for batch in batches:
            for i, j, rows, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = (np.frombuffer(p, f"<i{p[0]}", offset=1).astype(np.int64).reshape(rows, -1) for p in (a, b))
                got = _product(x, y).astype(object)
                tiles[i, j] = tiles[i, j] + got if (i, j) in tiles else got
                if len(tiles) > 512:  # 512 tiles are 4 MB of products
                    yield from out()
                    tiles.clear()
        yield from out()

    return run


class Whitening:
    """What is fitted: the number of distinct vectors, their sums, components and eigenvalues."""

    def __init__(self, n: int, total: list[int], covariance: np.ndarray, components: int):
        self.n, self.total = n, total
        e, u = np.linalg.eigh(covariance)
        e, u = e[::-1], u[:, ::-1]
        keep = min(components, int((e > LEAST_SHARE * max(e[0], 0.0)).sum())) if len(e) and e[0] > 0 else 0
        self.e, self.trace = e[:keep], float(np.trace(covariance))
        u = u[:, :keep]
        self.u = u * np.sign(u[np.abs(u).argmax(0), np.arange(keep)]) if keep else u
        self.centre = np.array([round(t / n) for t in total], np.int64)
        self.rest = np.array([(t - n * int(m)) / n for t, m in zip(total, self.centre, strict=True)])

    def project(self, v: np.ndarray) -> np.ndarray:
        """Whitened coordinates of grid vectors."""
        return ((v - self.centre) - self.rest) @ self.u / np.sqrt(self.e)

    def deviation(self, v: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exact."""
        n, total = self.n, self.total
        most = max(float(np.abs(v).max(initial=0)) * n, float(max(map(abs, total), default=0))) * 2
        if most * most * v.shape[1] < 2**62:
            d = n * v - np.array(total, np.int64)
            return pa.array((d * d).sum(1), pa.int64()).cast(_WHOLE)
        d = n * v.astype(object) - np.array(total, object)
        return _wholes((d * d).sum(1))


def _moments(fit: Whitening, dimension: int):
    """Sums of whitened coordinates (j = -1) and of their products over the fitted vectors."""
    k = len(fit.e)

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fit.project(_unpack(batch.column(0), dimension))
            one, two = one + w.sum(0), two + w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.arange(k), i)), pa.int32()), pa.array(np.concatenate((np.full(k, -1), j)), pa.int32()), pa.array(np.concatenate((one, two.ravel())), pa.float64())], ["i", "j", "s"])

    return run


def _project(fit: Whitening, dimension: int, scale: float, error: float):
    k = len(fit.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _grid(batch.column(1), dimension, scale)
            rows = len(v)
            each = pa.array(np.repeat(np.arange(rows), k), pa.int64())
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, fit.n), pa.int64()), fit.deviation(v).take(each), pa.array(fit.project(v).ravel(), pa.float64()),
                       pa.array(np.tile(fit.e / fit.trace, rows), pa.float64()), pa.array(np.full(rows * k, error), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def _covariance(rows: list, total: list[int], centre: np.ndarray, n: int, dimension: int, names: list[str]) -> np.ndarray:
    """The covariance from sums of centred products: (n P - D D') / n^2 in whole numbers, rounded once an entry."""
    p = np.zeros((dimension, dimension), object)
    for row in rows:
        a, b = row["i"] * TILE + row["r"], row["j"] * TILE
        for c, name in enumerate(names):
            if a < dimension and b + c < dimension:
                p[a, b + c] = p[b + c, a] = int(row[name])
    d = [t - n * int(m) for t, m in zip(total, centre, strict=True)]
    return np.array([[(n * p[a, b] - d[a] * d[b]) / (n * n) for b in range(dimension)] for a in range(dimension)], float)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    A vector is null, or holds a null or non-finite entry or one beyond 2**62 / scale: it goes.
    Where vectors differ in length those of the most frequent one stay (of equals the longer); empty
    vectors have no component and give no rows.  x = floor(scale * entry).  Each distinct x is fitted
    once: n of them.  Components are the covariance's unit eigenvectors by falling eigenvalue, the largest entry
    positive; those along which the fitted vectors do not vary are left out, so one distinct vector gives no
    rows.  deviation is the exact decimal sum of (n x - S)^2 with S the sums of x.  Adding a constant
    to x changes nothing.  Repeated rows and ids each keep their rows, a null id stays null, other columns are
    ignored, no rows give no rows.
    """
    spark = vectors.sparkSession
    schema = StructType([StructField("vec_id", vectors.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    none = spark.createDataFrame([], schema)
    v = F.col("_v")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale))
    rows = vectors.select(F.col(id_col).alias("_k"), F.col(vector_col).cast("array<double>").alias("_v")).where(fits & (F.size(v) > 0))
    size = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return none
    d = size["d"]
    rows = rows.where(F.size(v) == d)
    grid = materialize(rows.select("_v").mapInArrow(_packed(d, scale), "x binary").distinct(), "grid")
    sums = grid.mapInArrow(_sums(d), "dimension int, n long, total decimal(38,0)").groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dimension").collect()  # a row a dimension
    n, total = sums[0]["n"], [int(r["total"]) for r in sums]
    centre = np.array([round(t / n) for t in total], np.int64)
    blocks = materialize(grid.mapInArrow(_cut(d, centre), "row_block long, column_block int, rows int, entries binary"), "blocks")
    left = blocks.select("row_block", F.col("column_block").alias("i"), "rows", F.col("entries").alias("a"))
    right = blocks.select("row_block", F.col("column_block").alias("j"), F.col("entries").alias("b"))
    pairs = left.join(right, "row_block").where("i <= j").select("i", "j", "rows", "a", "b")
    names = [f"s{c}" for c in range(TILE)]
    tiles = pairs.mapInArrow(_multiply(names), "i int, j int, r int, " + ", ".join(f"{c} decimal(38,0)" for c in names))
    summed = tiles.groupBy("i", "j", "r").agg(*[F.sum(c).alias(c) for c in names]).collect()  # the square of the dimension
    fit = Whitening(n, total, _covariance(summed, total, centre, n, d, names), components)
    k = len(fit.e)
    if not k:
        discard(grid, blocks)
        return none
    moments = grid.mapInArrow(_moments(fit, d), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # the square of the components
    mean, second = np.zeros(k), np.zeros((k, k))
    for r in moments:
        if r["j"] < 0:
            mean[r["i"]] = r["s"] / n
        else:
            second[r["i"], r["j"]] = r["s"] / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    discard(grid, blocks)
    return rows.mapInArrow(_project(fit, d, scale, error), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on sixteen whitened components; the grid's constant of a million changes no figure."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
