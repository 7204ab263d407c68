"""Cross-validation of linear models over all folds at once.

Terms are counted inside each row and summed by fold, so the vocabulary of a
fold's training rows is what all development rows have less the fold's own, and no
validation text helps to choose or weigh a feature.  A row is stored once, as term numbers and
sublinear counts; a fold's idf goes into the weights instead, and its unit lengths into a factor a row.

A pass over the rows gives loss and gradient of every fold's model together: tasks sum
their own rows, the sums travel in slices that are added up on the executors, and the driver
gets one gradient, whose size follows the capped vocabulary.  L-BFGS advances all problems, logistic regression or
squared hinge, by the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.operators import terms as counting
from tessera.operators.features import ANALYZERS
from tessera.operators.ranks import with_rank
from tessera.operators.set_join import small_batches
from tessera.operators.tables import discard, materialize, spread
from tessera.operators.terms import _starts

#: Features of a slice of a gradient.
SLICE = 1 << 16
#: Entries of the rows that a pass takes at once.
ENTRIES = 1 << 19
#: Rows of a table that a reader holds at once.
READ_ROWS = 256
#: Share of a block's rows from which on a feature is a column of its matrix, which then has at most 1 / COMMON cells an entry.
COMMON = 0.04
#: Size of the step in which logistic regression counts a bias: its curvature is far over that of a weight, and of 0.03 to 1 this took the fewest passes. It changes no optimum and no test of one.
BIAS = 0.4
#: The same for the SVM, tried with 1 and 0.2.
HINGE_BIAS = 0.2
#: Fold whose rows no training sees; as a fold to validate, all others train for it.
PROTECTED = 0


# --- features -----------------------------------------------------------------------------------


def fold_sums(sums: DataFrame, sizes: dict[int, int], min_df: int = 2) -> DataFrame:
    """sums (block, term, df_<fold>..., total_<fold>...) of all development folds, added up by term, without terms that too few rows have."""
    known = [f for f in sizes if f is not None and f != PROTECTED]
    wide = sums.groupBy("block", "term").agg(*[F.sum(f"{x}_{f}").alias(f"{x}_{f}") for x in ("df", "total") for f in known])
    return wide.where(sum((F.col(f"df_{f}") for f in known), F.lit(0).cast("long")) >= min_df)  # a fold's rows are some of all


def fold_vocabularies(wide: DataFrame, sizes: dict[int, int], folds: tuple[int, ...], min_df: int = 2, max_df: float = 0.95, cap: int | None = 60_000) -> DataFrame:
    """(block, term, idf_<fold>...): the terms of each fold's training rows, from what fold_sums has, by subtraction; with a cap it is read twice.

    sizes: rows of each fold.  A term that a fold's vocabulary lacks has an idf of 0 there.  The cap is by
    training frequency, ties by term.
    """
    known = [f for f in sizes if f is not None and f != PROTECTED]
    everyone = sum(n for f, n in sizes.items() if f != PROTECTED)
    trained = {f: everyone - (sizes.get(f, 0) if f != PROTECTED else 0) for f in folds}
    others = lambda x, f: sum((F.col(f"{x}_{g}") for g in known if g != f), F.lit(0).cast("long"))
    each = wide.select("block", "term", F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(trained[f]).alias("n"), others("df", f).alias("df"), others("total", f).alias("total")) for f in folds])).alias("e")).select("block", "term", "e.*")
    each = each.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if cap is not None:
        each = _most_frequent(each, cap)
    idf = F.log((1 + F.col("n").cast("double")) / (1 + F.col("df"))) + 1
    return each.groupBy("block", "term").agg(*[F.coalesce(F.max(F.when(F.col("fold") == f, idf)), F.lit(0.0)).alias(f"idf_{f}") for f in folds])


def _most_frequent(each: DataFrame, cap: int) -> DataFrame:
    """The `cap` largest totals of each block and fold, ties by term: terms are counted by total first, and only those that reach the total of the last one are sorted."""
    group = Window.partitionBy("block", "fold")
    before = F.sum("_n").over(group.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1))
    totals = each.groupBy("block", "fold", "total").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    least = totals.where(F.col("_before") < cap).groupBy("block", "fold").agg(F.min("total").alias("_least"))  # a row a block and fold
    near = each.join(F.broadcast(least), ["block", "fold"]).where(F.col("total") >= F.col("_least"))
    return near.withColumn("_r", F.row_number().over(group.orderBy(F.desc("total"), "term"))).where(F.col("_r") <= cap).drop("_least", "_r")


def _small_batches(spark: SparkSession) -> None:
    """As small_batches; and tables of packed rows are read so many rows at once, whose arrays have thousands of entries each."""
    small_batches(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


@dataclass
class FoldFeatures:
    """The vocabularies of all folds in one table (block, term, idx, idf_<fold>...), and the idf of each as an array."""

    blocks: tuple[str, ...]
    profile: Callable[[Column], Column]
    folds: tuple[int, ...]
    table: DataFrame
    idf: np.ndarray  # folds x features
    starts: list[int]  # the first feature of each block

    def sizes(self) -> dict[int, int]:
        """Features of each fold's model."""
        return {f: int((self.idf[k] > 0).sum()) for k, f in enumerate(self.folds)}

    def rows(self, df: DataFrame, key: str, text: str, label: str, fold: str = "fold") -> DataFrame:
        """(doc, fold, label, idx, val) of df: a row without any known term has empty arrays.  label: a number, or null."""
        return self.packed(_cut(df, _head(key, fold, label), text, self.profile, self.blocks))

    def packed(self, cut: DataFrame) -> DataFrame:
        """The same of rows that are cut."""
        _small_batches(cut.sparkSession)
        known = self.table.select("block", "term", "idx").toPandas()  # a capped vocabulary a fold
        told = [(own["term"].tolist(), own["idx"].to_numpy()) for own in (known[known["block"] == b] for b in self.blocks)]
        schema = StructType([*cut.schema.fields[:3], StructField("idx", ArrayType(IntegerType())), StructField("val", ArrayType(DoubleType()))])
        return cut.mapInArrow(counting.packed(self.blocks, cut.sparkSession.sparkContext.broadcast(told)), schema)


def _head(key: str, fold: str, label: str) -> list[Column]:
    return [F.col(key).alias("doc"), F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("label")]


def _cut(df: DataFrame, head: list[Column], text: str, profile: Callable[[Column], Column], blocks: tuple[str, ...]) -> DataFrame:
    """head, and what each block cuts the profiled text into."""
    names = [f"_head_{k}" for k in range(len(head))]
    told = spread(df.select(*[h.alias(n) for h, n in zip(head, names, strict=True)], F.col(text).alias("_raw"))).select(*names, profile(F.col("_raw")).alias("_text"))
    named = df.select(*head).columns
    return told.select(*[F.col(n).alias(c) for n, c in zip(names, named, strict=True)], *[ANALYZERS[b][0](F.col("_text")).alias(f"_cut_{b}") for b in blocks])


def features_of(table: DataFrame, profile: Callable[[Column], Column], blocks: tuple[str, ...], folds: tuple[int, ...]) -> FoldFeatures:
    """Features from their table, which may have been written before."""
    told = table.select("block", "idx", *[f"idf_{f}" for f in folds]).toPandas()  # numbers of a capped vocabulary
    idf = np.zeros((len(folds), len(told)))
    idf[:, told["idx"]] = told[[f"idf_{f}" for f in folds]].to_numpy().T
    starts = [int((told["block"].isin(blocks[:k])).sum()) for k in range(len(blocks))]
    return FoldFeatures(tuple(blocks), profile, tuple(folds), table, idf, starts)


def fit_features(df: DataFrame, key: str, text: str, label: str, fold: str, profile: Callable[[Column], Column], blocks: tuple[str, ...] = ("word", "character"), folds: tuple[int, ...] = (1, 2, 3, 4), cap: int | None = 60_000, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[FoldFeatures, DataFrame]:
    """(features of every fold, the rows of df on them); df's texts are cut once, into a table, and only sums by term and fold are shuffled.

    keep: writes the rows, by default into the shared folder, and reads them again.
    """
    _small_batches(df.sparkSession)
    held = materialize(_cut(df, _head(key, fold, label), text, profile, blocks), "cut")
    sizes = {r["fold"]: r["n"] for r in held.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    empty = [f for f in folds if not sizes.get(f) or not sum(n for g, n in sizes.items() if g not in (f, PROTECTED))]
    if empty:
        raise ValueError(f"folds {empty} leave no training or no validation rows")
    own = tuple(f for f in sizes if f is not None and f != PROTECTED)
    schema = ", ".join(["block string", "term string", *[f"{x}_{f} long" for x in ("df", "total") for f in own]])
    sums = held.where(F.col("fold") != PROTECTED).select(*[f"_cut_{b}" for b in blocks], "fold").mapInArrow(counting.sums_by_term(blocks, own), schema)
    wide = materialize(fold_sums(sums, sizes), "term-sums")
    vocab = fold_vocabularies(wide, sizes, folds, cap=cap).withColumn("_b", F.array_position(F.array(*map(F.lit, blocks)), F.col("block")))
    table = materialize(with_rank(vocab, [], ["_b", "term"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int")).drop("_b"), "vocabulary")
    discard(wide)
    made = features_of(table, profile, blocks, folds)
    kept = (keep or (lambda rows: materialize(rows, "fold-rows")))(made.packed(held))
    discard(held)
    return made, kept


def dense_rows(df: DataFrame, key: str, vector: str, label: str, fold: str, dimension: int) -> DataFrame:
    """(doc, fold, label, idx, val) of dense vectors: the same problems, every feature in every row."""
    return df.select(F.col(key).alias("doc"), F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("label"), F.array(*map(F.lit, range(dimension))).alias("idx"), F.col(vector).cast("array<double>").alias("val"))


# --- passes over the rows -----------------------------------------------------------------------


@dataclass
class Spec:
    """What a task must know of the problems beside their weights."""

    folds: tuple[int, ...]
    classes: int
    features: int
    starts: tuple[int, ...]
    problems: tuple[int, ...] = ()  # the place in folds of each problem
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # problems x classes: the weight of a training row


class _Rows:
    """A batch of rows as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, spec: Spec, scaled: bool = True):
        self.spec, self.n = spec, batch.num_rows
        self.fold = batch.column("fold").to_numpy(zero_copy_only=False)
        self.label = pc.fill_null(batch.column("label"), -1).to_numpy(zero_copy_only=False)
        self.idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False)
        self.val = batch.column("val").flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.n), pc.list_value_length(batch.column("idx")).to_numpy(zero_copy_only=False))
        self.place = self.row * len(spec.starts) + (np.searchsorted(spec.starts, self.idx, "right") - 1)
        if scaled and "scale" in batch.schema.names:
            scale = batch.column("scale").flatten().to_numpy(zero_copy_only=False).reshape(self.n, len(spec.folds), -1)
            self.scaled = [self.val * scale[:, k].ravel()[self.place] for k in range(len(spec.folds))]

    def times(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Scores: rows x columns, the columns of a problem side by side."""
        out, k = np.zeros((self.n, len(weights))), self.spec.classes
        for c, w in enumerate(weights):
            out[:, c] = np.bincount(self.row, self.scaled[self.spec.problems[c // k]] * w[self.idx], self.n)
        return out + bias

    def own(self, which: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Scores of each row by the problem that `which` names: rows x classes."""
        k, of = self.spec.classes, which[self.row]
        out = bias.reshape(-1, k)[which]
        for p, f in enumerate(self.spec.problems):
            at = np.flatnonzero(of == p)
            if len(at):
                row, idx, x = self.row[at], self.idx[at], self.scaled[f][at]
                for c in range(k):
                    out[:, c] += np.bincount(row, x * weights[p * k + c][idx], self.n)
        return out

    def trains(self, problem: int) -> np.ndarray:
        """The weight of each row in a problem's training: 0 for the fold that it validates, the protected one, and rows without a label."""
        f = self.spec.folds[self.spec.problems[problem]]
        return np.where((self.fold != f) & (self.fold != PROTECTED) & (self.label >= 0), self.spec.weights[problem][np.maximum(self.label, 0)], 0.0)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _logistic(scores: list[np.ndarray], rows: _Rows, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    k, (s,) = spec.classes, scores
    loss, out = np.zeros(s.shape[1]), np.zeros_like(s)
    hot = rows.label[:, None] == np.arange(k)
    for p in range(len(spec.problems)):
        w, own = rows.trains(p), s[:, p * k : p * k + k]
        top = own.max(1)
        loss[p * k] = (w * (top + np.log(np.exp(own - top[:, None]).sum(1)) - np.where(hot, own, 0).sum(1))).sum()
        out[:, p * k : p * k + k] = w[:, None] * (_softmax(own) - hot)
    return loss, out


def _margins(s: np.ndarray, rows: _Rows, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = spec.classes
    sign = np.tile(np.where(rows.label[:, None] == np.arange(k), 1.0, -1.0), len(spec.problems))
    w = np.repeat(np.stack([rows.trains(p) for p in range(len(spec.problems))], 1), k, 1)
    return sign, w, np.maximum(0.0, 1 - sign * s)


def _squared_hinge(scores, rows, spec):
    sign, w, short = _margins(scores[0], rows, spec)
    return (w * short * short).sum(0), -2 * w * sign * short


def _class_sums(scores, rows, spec):
    hot = rows.label[:, None] == np.arange(spec.classes)
    return np.zeros(scores[0].shape[1]), np.concatenate([rows.trains(p)[:, None] * hot for p in range(len(spec.problems))], 1)


LOSSES = {"logistic": _logistic, "squared_hinge": _squared_hinge, "class_sums": _class_sums}


class _Block:
    """Many rows as flat arrays.  Features that many of them have are columns of a matrix; the other entries stand by row, and by feature in layers.

    A layer holds at most one entry a feature, and its features are the first of the layer before: a sum by feature is a few sums of whole arrays.
    """

    def __init__(self, told: dict, spec: Spec):
        values = np.frombuffer(told["values"])
        get = lambda name: np.take(values, np.frombuffer(told[name], _code(len(values)))) if name in _CODED else np.frombuffer(told[name], _KINDS[name])
        self.spec, self.fold, self.label = spec, get("fold"), get("label")
        self.n, self.s = len(self.fold), len(spec.starts)
        self.idx, self.val = get("idx"), get("val")
        self.ends = np.cumsum(get("sizes"))
        self.feature, self.layers, self.layer_place, self.layer_val = get("feature"), get("layers"), get("layer_place"), get("layer_val")
        self.common = get("common")
        self.matrix = np.zeros((self.n, len(self.common)))
        self.matrix.ravel()[get("common_at")] = get("common_val")
        bounds = np.append(np.searchsorted(self.common, spec.starts), len(self.common)).tolist()
        self.sections = [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if lo < hi]
        k = [f for p in spec.problems for f in [p] * spec.classes]
        self.scale = get("scale").reshape(self.n, len(spec.folds), self.s)[:, k].transpose(0, 2, 1)

    trains = _Rows.trains

    def times(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """weights: features x columns."""
        out, a = np.zeros((self.n * self.s, weights.shape[1])), 0
        for k, b in enumerate(self.ends.tolist()):
            if a < b:
                out[k] = self.val[a:b] @ np.take(weights, self.idx[a:b], 0)
                a = b
        out = out.reshape(self.n, self.s, -1)
        for k, own in self.sections:
            out[:, k] += self.matrix[:, own] @ np.take(weights, self.common[own], 0)
        return (out * self.scale).sum(1) + bias

    def add(self, residual: np.ndarray, total: np.ndarray) -> None:
        each = residual[:, None] * self.scale
        for k, own in self.sections:
            total[self.common[own]] += self.matrix[:, own].T @ each[:, k]
        each = each.reshape(self.n * self.s, -1)
        sums, a = np.zeros((len(self.feature), each.shape[1])), 0
        for size in self.layers.tolist():
            part = np.take(each, self.layer_place[a : a + size], 0)
            part *= self.layer_val[a : a + size, None]
            sums[:size] += part
            a += size
        total[self.feature] += sums


#: Entries by their places among the block's distinct values: of counts there are few.
_CODED = ("val", "layer_val", "common_val")
_KINDS = dict.fromkeys(("fold", "label", "idx", "sizes", "feature", "layers", "layer_place", "common", "common_at"), np.int32) | dict.fromkeys(("values", "scale"), np.float64)
_BLOCK = ", ".join(f"{name} binary" for name in (*_KINDS, *_CODED))


def _code(values: int) -> type:
    return np.uint8 if values <= 1 << 8 else np.uint16 if values <= 1 << 16 else np.uint32


def _block(rows: _Rows, scale: np.ndarray) -> dict[str, bytes]:
    """The arrays of a _Block."""
    values, code = np.unique(rows.val, return_inverse=True)
    count = np.bincount(rows.idx, minlength=rows.spec.features)
    common = np.flatnonzero(count >= max(COMMON * rows.n, 2))
    column = np.full(rows.spec.features, -1)
    column[common] = np.arange(len(common))
    at = column[rows.idx]
    dense, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    order = rest[np.argsort(rows.idx[rest], kind="stable")]
    start = _starts(rows.idx[order])
    size = np.diff(np.append(start, len(order)))
    by_size = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[by_size] = np.arange(len(size))
    layer = np.arange(len(order)) - np.repeat(start, size)  # of an entry: how many its feature has before it
    order = order[np.lexsort((np.repeat(rank, size), layer))]
    told = {
        "values": values, "fold": rows.fold, "label": rows.label, "scale": scale,
        "common": common, "common_at": rows.row[dense] * len(common) + at[dense], "common_val": code[dense],
        "idx": rows.idx[rest], "val": code[rest], "sizes": np.bincount(rows.place[rest], minlength=rows.n * len(rows.spec.starts)),
        "feature": np.sort(rows.idx[rest])[start][by_size], "layers": np.bincount(layer), "layer_place": rows.place[order], "layer_val": code[order],
    }
    return {name: x.astype(_KINDS.get(name, _code(len(values)))).tobytes() for name, x in told.items()}


def _blocks(spec: Spec):
    """Rows with their scale, many in a row of arrays: ENTRIES of a task's rows, however they are dealt over batches."""

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = _block(_Rows(batch, spec, scaled=False), batch.column("scale").flatten().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array([told[name]], pa.binary()) for name in (*_KINDS, *_CODED)], [*_KINDS, *_CODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch.column("idx").flatten()) + batch.num_rows
            if count <= ENTRIES:
                continue
            batch = pa.concat_batches(held)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("idx")).to_numpy(zero_copy_only=False) + 1)))  # a row without entries counts too
            a = 0
            while ends[-1] - ends[a] > ENTRIES:
                b = max(int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1, a + 1)
                yield packed(batch.slice(a, b - a))
                a = b
            held, count = [batch.slice(a)], int(ends[-1] - ends[a])
        if count:
            yield packed(pa.concat_batches(held))

    return run


def _partials(loss: str, spec: Spec, told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [(np.ascontiguousarray(w.T), b) for w, b in told.value]
        columns = weights[0][0].shape[1]
        total, scalars = np.zeros((spec.features, columns)), np.zeros((2, columns))
        for batch in batches:
            for block in batch.to_pylist():
                rows = _Block(block, spec)
                lost, residual = LOSSES[loss]([rows.times(w, b) for w, b in weights], rows, spec)
                scalars += (lost, residual.sum(0))
                rows.add(residual, total)
        slices = -(-spec.features // SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([scalars.tobytes()], pa.binary())], ["part", "sums"])
        for c in range(columns):
            own = np.ascontiguousarray(total[:, c])
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(range(c * slices, c * slices + slices), pa.int32()), pa.array([own[k * SLICE : (k + 1) * SLICE].tobytes() for k in range(slices)], pa.binary())], ["part", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(data.as_buffer(), np.float64)
            if part in sums:
                sums[part] += x
            else:
                sums[part] = x.copy()
    for part, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "sums"])


def _with_scale(spec: Spec, told):
    """Rows with a factor for each fold and block: one over the length that the fold's idf gives the row."""

    def run(batches):
        idf, s = told.value, len(spec.starts)
        for batch in batches:
            rows = _Rows(batch, spec)
            out = np.ones((rows.n, len(spec.folds), s))
            if idf is not None:
                for k in range(len(spec.folds)):
                    w = rows.val * idf[k][rows.idx]
                    length = np.sqrt(np.bincount(rows.place, w * w, rows.n * s)).reshape(rows.n, s)
                    out[:, k] = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0)
            ends = np.arange(rows.n + 1, dtype=np.int32) * (len(spec.folds) * s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, out.ravel())], [*batch.schema.names, "scale"])

    return run


class Problems:
    """Rows and folds of a set of problems that are solved together.  close() gives back what it holds."""

    def __init__(self, rows: DataFrame, classes: int, folds: tuple[int, ...], features: int, idf: np.ndarray | None = None, starts: tuple[int, ...] = (0,)):
        self.spark, self.idf = rows.sparkSession, idf
        _small_batches(self.spark)  # of packed rows too: a task reads all of its blocks otherwise
        self.spec = Spec(tuple(folds), classes, features, tuple(starts))
        self.rows, self.told = rows, self.spark.sparkContext.broadcast(idf)
        self.scaled = self.scale(rows)
        self.held: DataFrame | None = None
        counts = rows.where(F.col("label").isNotNull()).groupBy("fold", "label").agg(F.count("*").alias("n")).collect()  # folds x classes
        self.counts = np.zeros((len(folds), classes))  # training rows of each fold and class
        for r in counts:
            for k, f in enumerate(folds):
                if r["fold"] not in (f, PROTECTED):
                    self.counts[k, r["label"]] += r["n"]

    def scale(self, rows: DataFrame) -> DataFrame:
        schema = StructType([*rows.schema.fields, StructField("scale", ArrayType(DoubleType()))])
        return rows.mapInArrow(_with_scale(self.spec, self.told), schema)

    def scaled_by(self, run: Callable) -> Callable:
        """run on scaled batches, in the task that scales them."""
        scale = _with_scale(self.spec, self.told)
        return lambda batches: run(scale(batches))

    def blocks(self) -> DataFrame:
        """The rows as passes read them, on the executors' disks: a cache in their heaps leaves no room for readers of the rows."""
        if self.held is None:
            self.held = self.rows.mapInArrow(self.scaled_by(_blocks(self.spec)), _BLOCK).persist(StorageLevel.DISK_ONLY)
        return self.held

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()

    def class_weights(self, balanced: bool) -> np.ndarray:
        """folds x classes: 1, or rows / (classes that there are * rows of the class)."""
        if not balanced:
            return np.ones_like(self.counts)
        there = (self.counts > 0).sum(1, keepdims=True)
        return np.where(self.counts > 0, self.counts.sum(1, keepdims=True) / np.maximum(there * self.counts, 1), 0.0)

    def effective(self, weights: np.ndarray, spec: Spec) -> np.ndarray:
        """Weights with each problem's idf in them: problems * classes x features."""
        return weights if self.idf is None else weights * np.repeat(self.idf[list(spec.problems)], spec.classes, 0)

    def sums(self, loss: str, spec: Spec, *weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss, gradient by bias, gradient by weight) of every column, over all rows."""
        told = self.spark.sparkContext.broadcast([(self.effective(w, spec), b) for w, b in weights])
        cores = self.spark.sparkContext.defaultParallelism  # each task sends a gradient
        partial = self.blocks().coalesce(cores).mapInArrow(_partials(loss, spec, told), "part int, sums binary")
        summed = partial.repartition(cores, "part").mapInArrow(_added, "part int, sums binary").collect()  # one gradient
        columns, slices = weights[0][0].shape[0], -(-spec.features // SLICE)
        scalars, total = np.zeros((2, columns)), np.zeros((columns, spec.features))
        for r in summed:
            if r["part"] < 0:
                scalars = np.frombuffer(r["sums"]).reshape(2, -1)
            else:
                c, k = divmod(r["part"], slices)
                total[c, k * SLICE : (k + 1) * SLICE] = np.frombuffer(r["sums"])
        told.unpersist()
        discard()  # shuffle files of the passes before
        return scalars[0], scalars[1], self.effective(total, spec)

    def problem_spec(self, problems: list[int], weights: np.ndarray) -> Spec:
        s = self.spec
        return Spec(s.folds, s.classes, s.features, s.starts, tuple(problems), weights)


# --- solvers ------------------------------------------------------------------------------------


class _Lbfgs:
    """One problem's state: propose() a point, tell() its value and gradient.

    unit: the size of each coordinate's step; directions are found in coordinates divided by it, the end is told by the gradient as it is.
    """

    def __init__(self, size: int, memory: int, tolerance: float, unit: np.ndarray | float = 1.0):
        self.unit = unit
        self.x, self.f, self.g = np.zeros(size), np.inf, None
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.memory, self.tolerance, self.done, self.step, self.d, self.evaluations = memory, tolerance, False, 0.0, np.zeros(size), 0

    def propose(self) -> np.ndarray:
        return self.x + self.step * self.d if self.step else self.x

    def tell(self, f: float, g: np.ndarray) -> None:
        self.evaluations += 1
        if self.g is not None:
            slope = float(self.g @ self.d)
            if f > self.f + 1e-4 * self.step * slope:  # too far: halve
                self.step /= 2
                self.done = self.step < 1e-10
                return
            s, y = self.step * self.d / self.unit, (g - self.g) * self.unit
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[-self.memory + 1 :], (s, y, float(s @ y))]
            self.x = self.x + self.step * self.d
        self.f, self.g = f, g
        if np.abs(g).max(initial=0) <= self.tolerance:
            self.done = True
            return
        q, rates = g * self.unit, []
        for s, y, sy in reversed(self.pairs):
            a = float(s @ q) / sy
            rates.append(a)
            q -= a * y
        if self.pairs:
            s, y, sy = self.pairs[-1]
            q *= sy / float(y @ y)
        for (s, y, sy), a in zip(self.pairs, reversed(rates), strict=True):
            q += (a - float(y @ q) / sy) * s
        self.d = -q * self.unit
        self.step = 1.0 if self.pairs else min(1.0, 1 / float(np.abs(g).sum() or 1))


@dataclass
class Fitted:
    """Weights (problems * classes x features, on unit-length tf-idf values) and biases; kind names what scores mean."""

    kind: str
    spec: Spec
    weights: np.ndarray
    bias: np.ndarray
    loss: np.ndarray
    passes: int


def fit_logistic(data: Problems, c: float = 1.0, balanced: bool = False, tolerance: float = 1e-4, most: int = 1000, memory: int = 6, problems: list[tuple[int, float, bool]] | None = None) -> Fitted:
    """Multinomial logistic regression of every fold: mean loss plus |W|^2 / (2 c n), biases free.

    problems: (place of the fold, c, balanced) of each, by default one a fold.  A problem ends when no entry of its gradient
    is over the tolerance; one that does not within `most` passes raises.
    """
    problems = problems or [(k, c, balanced) for k in range(len(data.spec.folds))]
    k, u = data.spec.classes, data.spec.features
    weigh = np.array([data.class_weights(b)[f] for f, _, b in problems])
    mass = np.array([(w * data.counts[f]).sum() for w, (f, _, _) in zip(weigh, problems, strict=True)])
    ridge = 1 / (np.array([x for _, x, _ in problems]) * mass)
    unit = np.append(np.ones(k * u), np.full(k, BIAS))
    states = [_Lbfgs(k * u + k, memory, tolerance, unit) for _ in problems]
    for passes in range(1, most + 1):  # noqa: B007
        open_ = [p for p, s in enumerate(states) if not s.done]
        if not open_:
            break
        trial = [states[p].propose() for p in open_]
        spec = data.problem_spec([problems[p][0] for p in open_], weigh[open_] / mass[open_][:, None])
        loss, gb, gw = data.sums("logistic", spec, (np.concatenate([t[: k * u].reshape(k, u) for t in trial]), np.concatenate([t[k * u :] for t in trial])))
        for at, (p, t) in enumerate(zip(open_, trial, strict=True)):
            w = t[: k * u]
            g = np.concatenate((gw[at * k : at * k + k].ravel() + ridge[p] * w, gb[at * k : at * k + k]))
            states[p].tell(float(loss[at * k]) + ridge[p] / 2 * float(w @ w), g)
    else:
        raise RuntimeError(f"logistic regression is not settled after {most} passes")
    spec = data.problem_spec([f for f, _, _ in problems], weigh)
    return Fitted("logistic", spec, np.concatenate([s.x[: k * u].reshape(k, u) for s in states]), np.concatenate([s.x[k * u :] for s in states]), np.array([s.f for s in states]), passes - 1)


def fit_squared_hinge(data: Problems, c: float = 1.0, balanced: bool = False, tolerance: float = 1e-4, most: int = 1000, memory: int = 6) -> Fitted:
    """One-against-rest linear SVMs of every fold: |w|^2 / 2 + c * sum of squared hinge losses, the bias as one more weight.

    L-BFGS of every column by the same passes; a column rests once its gradient has fallen by the tolerance, a fold is left
    out of the passes when all of its columns rest.
    """
    k, u, n = data.spec.classes, data.spec.features, len(data.spec.folds)
    weigh = c * data.class_weights(balanced)
    unit = np.append(np.ones(u), HINGE_BIAS)
    states = [_Lbfgs(u + 1, memory, 0.0, unit) for _ in range(k * n)]
    first = np.zeros(k * n)
    for passes in range(1, most + 1):  # noqa: B007
        open_ = [f for f in range(n) if not all(s.done for s in states[f * k : f * k + k])]
        if not open_:
            break
        own = [f * k + j for f in open_ for j in range(k)]
        trial = np.array([states[p].propose() for p in own])
        loss, gb, gw = data.sums("squared_hinge", data.problem_spec(open_, weigh[open_]), (trial[:, :u], trial[:, u]))
        for at, (p, x) in enumerate(zip(own, trial, strict=True)):
            s = states[p]
            if s.done:
                continue
            g = np.append(gw[at], gb[at]) + x
            if s.g is None:
                first[p] = np.sqrt(g @ g)
            s.tell(float(loss[at]) + float(x @ x) / 2, g)
            if np.sqrt(s.g @ s.g) <= tolerance * first[p]:
                s.done, s.step = True, 0.0
    else:
        raise RuntimeError(f"the SVM is not settled after {most} passes")
    spec = data.problem_spec(list(range(n)), weigh)
    x = np.array([s.x for s in states])
    return Fitted("margin", spec, x[:, :u], x[:, u], np.array([s.f for s in states]), passes - 1)


def fit_naive_bayes(data: Problems, alpha: float = 1.0) -> Fitted:
    """Multinomial naive Bayes of every fold on its tf-idf values: one pass."""
    k, u, folds = data.spec.classes, data.spec.features, range(len(data.spec.folds))
    spec = data.problem_spec(list(folds), np.ones_like(data.counts))
    _, _, sums = data.sums("class_sums", spec, (np.zeros((k * len(folds), u)), np.zeros(k * len(folds))))
    width = (data.idf > 0).sum(1) if data.idf is not None else np.full(len(folds), u)
    known = np.repeat(data.idf > 0, k, 0) if data.idf is not None else np.ones_like(sums, bool)
    mass = sums.sum(1) + alpha * np.repeat(width, k)
    weights = np.where(known, np.log(sums + alpha) - np.log(mass)[:, None], 0.0)
    with np.errstate(divide="ignore"):
        prior = np.log(data.counts / data.counts.sum(1, keepdims=True)).ravel()
    return Fitted("log_joint", spec, weights, np.maximum(prior, -1e300), np.zeros(len(folds)), 1)


def _predicted(spec: Spec, told, own_fold: bool):
    def run(batches):
        weights, bias = told.value
        for batch in batches:
            rows = _Rows(batch, spec)
            which = np.full(rows.n, len(spec.problems) - 1)
            if own_fold:
                for p, f in enumerate(spec.problems):
                    which[rows.fold == spec.folds[f]] = p
            own = rows.own(which, weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("fold"), batch.column("label"), pa.array(own.argmax(1), pa.int32()), pa.array(_softmax(own).max(1) if rows.n else np.zeros(0), pa.float64())], ["doc", "fold", "label", "prediction", "confidence"])

    return run


def predict(data: Problems, fitted: Fitted, rows: DataFrame | None = None, own_fold: bool = True) -> DataFrame:
    """(doc, fold, label, prediction, confidence): each row by the model that its fold did not train.

    rows: others than those fitted, on the same features.  own_fold=False: all by the last problem's model.  Rows of a
    fold without a model are left out.  The confidence is the largest of the scores' softmax; the first of equal classes wins.
    """
    rows = data.rows if rows is None else rows
    if own_fold:
        rows = rows.where(F.col("fold").isin([data.spec.folds[p] for p in fitted.spec.problems]))
    told = data.spark.sparkContext.broadcast((data.effective(fitted.weights, fitted.spec), fitted.bias))
    schema = StructType([*rows.select("doc", "fold", "label").schema.fields, StructField("prediction", IntegerType()), StructField("confidence", DoubleType())])
    return rows.mapInArrow(data.scaled_by(_predicted(fitted.spec, told, own_fold)), schema)
