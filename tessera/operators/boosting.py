"""Boosted trees under the softmax loss, of all folds at once, by histograms of sparse columns.

A column's values fall into bins by their quantiles among a fold's training rows.  A
round grows one tree a class and fold, level by level: tasks sum gradients and curvatures by tree,
node, column and bin, columns are dealt out, and the best split of each node among a task's own
columns goes to the driver, which gets a few numbers a node.  A row without a value in
the column of a split goes the way that gains more.  So one child of a split has rows with a value alone, and a column
whose rows have less curvature than a child needs can split no node: a round first finds the columns that can.

Gradients are whole multiples of 1 / UNIT, so sums are exact: trees do not depend on how
rows are dealt or on tasks that run again.  Scores of rows are written every KEEP rounds, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tessera.operators.crossval import PROTECTED, Problems, Spec, _Rows, _softmax
from tessera.operators.tables import discard, materialize

#: Bins of a column, the number that stands for no value, and steps of a value to which quantiles are exact.
BINS, ABSENT, STEPS = 16, 255, 4096
UNIT = 1 << 24
#: Rounds between tables of scores.
KEEP = 10
#: Sums that a task holds before it adds them up and, if they are still as many, sends them on.
HELD = 4_000_000
#: Shares that columns are dealt out in, at most.
PARTS = 256
#: A split must gain more.
LEAST_GAIN = 1e-6
_SUMS = "part int, keys binary, sums binary"
_BEST = "tree int, node int, gain double, feature int, bin int, absent_left boolean, left array<double>, all array<double>"


@dataclass
class Boosted:
    """Trees as heaps: the children of node i are 2i + 1 and 2i + 2; a feature of -1 ends a path.  The first axis is the
    round, the second the tree (fold * classes + class)."""

    spec: Spec
    cuts: np.ndarray  # folds x features x (BINS - 1)
    depth: int
    feature: np.ndarray
    bin: np.ndarray
    absent_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def part(self, first: int, last: int) -> Boosted:
        """Rounds first to last - 1, without the cuts."""
        s = slice(first, last)
        return Boosted(self.spec, self.cuts[:, :0], self.depth, self.feature[s], self.bin[s], self.absent_left[s], self.value[s], self.gain[s])


class _Binned:
    def __init__(self, batch: pa.RecordBatch, spec: Spec):
        self.n, self.spec = batch.num_rows, spec
        self.fold = batch.column("fold").to_numpy(zero_copy_only=False)
        self.label = pc.fill_null(batch.column("label"), -1).to_numpy(zero_copy_only=False)
        self.draw = batch.column("draw").to_numpy(zero_copy_only=False).view(np.uint64)
        self.idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), pc.list_value_length(batch.column("idx")).to_numpy(zero_copy_only=False))
        self.keys = self.row * spec.features + self.idx  # ascending: a row's numbers are
        self.bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(self.idx), len(spec.folds))
        self.scores = np.frombuffer(b"".join(batch.column("scores").to_pylist())).reshape(self.n, len(spec.folds) * spec.classes)

    def nodes(self, m: Boosted, r: int) -> np.ndarray:
        """rows x trees: where each row stands in the trees of round r."""
        trees = np.arange(m.feature.shape[1])
        node = np.zeros((self.n, len(trees)), np.int64)
        for _ in range(m.depth):
            inner = node < m.feature.shape[2]
            at = np.where(inner, node, 0)
            f = np.where(inner, m.feature[r, trees, at], -1)
            if (f < 0).all():
                break
            want = np.arange(self.n)[:, None] * self.spec.features + f
            pos = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
            b = np.full(f.shape, ABSENT)
            if len(self.keys):
                b = np.where(self.keys[pos] == want, self.bins[pos, trees // self.spec.classes], ABSENT)
            left = np.where(b == ABSENT, m.absent_left[r, trees, at], b <= m.bin[r, trees, at])
            node = np.where(f < 0, node, 2 * node + np.where(left, 1, 2))
        return node

    def after(self, m: Boosted, rounds: int) -> np.ndarray:
        """rows x trees: scores with the first rounds of m added."""
        out = self.scores.copy()
        for r in range(rounds):
            out += m.value[r, np.arange(out.shape[1]), self.nodes(m, r)]
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(x: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether each number is in the draw that seed names."""
    salt = _mixed(np.array([seed], np.uint64))[0]
    return (_mixed(x ^ salt) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their sums."""
    k, s = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(k)
    k, s = k.take(order), s.take(order, axis=0)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(s, first, axis=0) if len(k) else s


class _Sums:
    """Keys and sums of a task.  A key is the part that it goes to times per_part and a number below it; one below 0 goes to every part."""

    def __init__(self, parts: int, width: int, per_part: int):
        self.parts, self.width, self.per_part = parts, width, per_part
        self.keys, self.sums, self.held = [], [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.held += len(keys)
        if self.held > HELD:
            k, s = _summed(self.keys, self.sums)
            self.keys, self.sums, self.held = [k], [s], len(k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys, sums = _summed(self.keys, self.sums)
        self.keys, self.sums, self.held = [], [], 0
        ends = np.searchsorted(keys, np.arange(self.parts + 1) * self.per_part)
        for p in range(self.parts):
            k = np.concatenate((keys[: ends[0]], keys[ends[p] : ends[p + 1]] - p * self.per_part))
            if len(k):
                s = np.concatenate((sums[: ends[0]], sums[ends[p] : ends[p + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], ["part", "keys", "sums"])


def _parts_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and sums of each part of a task."""
    parts: dict[int, tuple[list, list, int]] = {}
    for batch in batches:
        for p, k, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys, sums, held = parts.get(p, ([], [], 0))
            keys.append(np.frombuffer(k, np.int64))
            sums.append(np.frombuffer(s, np.int64).reshape(-1, width))
            held += len(keys[-1])
            if held > HELD and len(keys) > 1:
                k, s = _summed(keys, sums)
                keys, sums, held = [k], [s], 0
            parts[p] = keys, sums, held
    for keys, sums, _ in parts.values():
        yield _summed(keys, sums)


# --- bins ---------------------------------------------------------------------------------------


def _levels(rows: _Rows, k: int, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether the fold k's model knows an entry, its value in steps)."""
    known = np.ones(len(rows.idx), bool) if idf is None else idf[k][rows.idx] > 0
    x = rows.scaled[k] if idf is None else rows.scaled[k] * idf[k][rows.idx]
    return known, np.clip(np.floor(x * STEPS), -32000, 32000).astype(np.int64)


def _level_counts(spec: Spec, told, parts: int):
    def run(batches):
        held = _Sums(parts, 1, (len(spec.folds) * spec.features) << 16)
        for batch in batches:
            rows = _Rows(batch, spec)
            for k, f in enumerate(spec.folds):
                known, level = _levels(rows, k, told.value)
                trains = ((rows.fold != f) & (rows.fold != PROTECTED) & (rows.label >= 0))[rows.row] & known
                idx = rows.idx[trains].astype(np.int64)
                keys = idx % parts * held.per_part + ((k * spec.features + idx) << 16) + level[trains] + (1 << 15)
                held.add(keys, np.ones((len(keys), 1), np.int64))
            if held.held > HELD:
                yield from held.rows()
        yield from held.rows()

    return run


def _quantiles(batches):
    for keys, counts in _parts_of(batches, 1):
        column, level = keys >> 16, (keys & 0xFFFF) - (1 << 15)
        first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        size = np.diff(np.append(first, len(keys)))
        up = np.cumsum(counts[:, 0])
        base = np.repeat(np.concatenate(([0], up))[first], size)
        total = np.repeat(np.add.reduceat(counts[:, 0], first), size)
        group = np.repeat(np.arange(len(first)), size)
        cuts = np.zeros((len(first), BINS - 1), np.int16)
        for i in range(1, BINS):  # the level that holds the row of rank ceil(i * total / BINS)
            rank = -(-i * total // BINS)
            hit = (up - base >= rank) & (up - base - counts[:, 0] < rank)
            cuts[group[hit], i - 1] = level[hit]
        yield pa.RecordBatch.from_arrays([pa.array([column[first].tobytes()], pa.binary()), pa.array([cuts.tobytes()], pa.binary())], ["columns", "cuts"])


def _cuts(data: Problems, parts: int, idf) -> np.ndarray:
    spec, cores = data.spec, data.spark.sparkContext.defaultParallelism
    counted = data.scaled.mapInArrow(_level_counts(spec, idf, parts), _SUMS).repartition(cores, "part")
    cuts = np.full((len(spec.folds) * spec.features, BINS - 1), np.iinfo(np.int16).max, np.int16)
    for r in counted.mapInArrow(_quantiles, "columns binary, cuts binary").collect():  # the capped vocabulary's
        cuts[np.frombuffer(r["columns"], np.int64)] = np.frombuffer(r["cuts"], np.int16).reshape(-1, BINS - 1)
    return cuts.reshape(len(spec.folds), spec.features, BINS - 1)


def _bin(spec: Spec, told):
    def run(batches):
        cuts, idf = told.value
        for batch in batches:
            rows = _Rows(batch, spec)
            bins = np.empty((len(rows.idx), len(spec.folds)), np.uint8)
            for k in range(len(spec.folds)):
                known, level = _levels(rows, k, idf)
                above = np.zeros(len(rows.idx), np.uint8)
                for i in range(BINS - 1):
                    above += level > cuts[k][rows.idx, i]
                bins[:, k] = np.where(known, above, ABSENT)
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows.row, minlength=rows.n))))
            none = np.zeros(len(spec.folds) * spec.classes).tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "fold", "label", "draw", "idx")), pa.array([bins[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array([none] * rows.n, pa.binary())], ["doc", "fold", "label", "draw", "idx", "bins", "scores"])

    return run


def _binned(data: Problems, cuts: np.ndarray, scaled: DataFrame) -> DataFrame:
    rows = scaled.withColumn("draw", F.xxhash64("doc"))
    schema = StructType([*rows.select("doc", "fold", "label", "draw", "idx").schema.fields, StructField("bins", BinaryType()), StructField("scores", BinaryType())])
    return rows.mapInArrow(_bin(data.spec, data.spark.sparkContext.broadcast((cuts, data.idf))), schema)


# --- trees --------------------------------------------------------------------------------------


def _pairs(p: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Gradient and curvature of a class's score, in units."""
    return np.rint(np.stack((p - hot, np.maximum(2 * p * (1 - p), 1e-6)), 1) * UNIT).astype(np.int64)


def _trains(b: _Binned, fold: int) -> np.ndarray:
    return (b.fold != fold) & (b.fold != PROTECTED) & (b.label >= 0)


def _curvatures(spec: Spec, told, share: float, enough: int):
    """(tree, the curvature of the rows that have each column), in units, each task's up to what is enough for a split."""

    def run(batches):
        m, rounds, seed = told.value
        u, k = spec.features, spec.classes
        total = np.zeros((len(spec.folds) * k, u))
        for batch in batches:
            b = _Binned(batch, spec)
            scores, drawn = b.after(m, rounds), _drawn(b.draw, seed, share)
            for f, fold in enumerate(spec.folds):
                p, here = _softmax(scores[:, f * k : f * k + k]), drawn & _trains(b, fold)
                take = here[b.row] & (b.bins[:, f] != ABSENT)
                row, idx = b.row[take], b.idx[take]
                for c in range(k):
                    total[f * k + c] += np.bincount(idx, _pairs(p[:, c], b.label == c)[row, 1], u)
        sums = np.minimum(total, enough).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], ["tree", "sums"])

    return run


def _able(enough: int):
    """(tree, a bit a column: whether its rows hold the curvature that a child needs)."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(s, np.int32)
                total[t] = np.minimum(total[t] + x, enough) if t in total else x.astype(np.int64)
        for t, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([np.packbits(x >= enough).tobytes()], pa.binary())], ["tree", "bits"])

    return run


def _histograms(spec: Spec, told, parts: int, nodes: int, share: float):
    def run(batches):
        m, rounds, level, seed, columns = told.value
        u, k, trees = spec.features, spec.classes, len(spec.folds) * spec.classes
        columns = np.unpackbits(columns, axis=1, count=u).astype(bool)
        held = _Sums(parts, 2, trees * nodes * u * BINS)
        for batch in batches:
            b = _Binned(batch, spec)
            scores, at = b.after(m, rounds), b.nodes(m, rounds)
            drawn = _drawn(b.draw, seed, share)
            for t in range(trees):
                f, c = t // k, t % k
                if c == 0:
                    p = _softmax(scores[:, f * k : f * k + k])
                here = drawn & _trains(b, spec.folds[f]) & (at[:, t] >= 2**level - 1)
                pair = _pairs(p[:, c], b.label == c)
                place = t * nodes + at[:, t]
                held.add(-1 - place[here], pair[here])
                take = here[b.row] & columns[t][b.idx] & (b.bins[:, f] != ABSENT)
                row, idx = b.row[take], b.idx[take]
                held.add(idx % parts * held.per_part + (place[row] * u + idx) * BINS + b.bins[take, f], pair.take(row, axis=0))
            if held.held > HELD:
                yield from held.rows()
        yield from held.rows()

    return run


def split_gains(keys: np.ndarray, sums: np.ndarray, features: int, ridge: float, least: float) -> list[tuple]:
    """(place, gain, feature, bin, absent_left, left sums, all sums): the best split of each place, a gain of 0 where none is.

    Keys: -1 - place for a place's sums, (place * features + feature) * BINS + bin for a histogram's.  Of equal gains the
    first feature, bin and absent rows to the right win.
    """
    lone = int(np.searchsorted(keys, 0))
    places, totals = -1 - keys[:lone][::-1], sums[:lone][::-1]
    out = {int(p): (int(p), 0.0, -1, 0, False, [0.0, 0.0], (t / UNIT).tolist()) for p, t in zip(places, totals, strict=True)}
    k, s = keys[lone:], sums[lone:]
    if len(k):
        column = k // BINS
        first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        size = np.diff(np.append(first, len(k)))
        up = np.cumsum(s, axis=0)
        up = up - np.repeat(np.concatenate((np.zeros((1, 2), np.int64), up))[first], size, axis=0)
        told = np.repeat(np.add.reduceat(s, first, axis=0), size, axis=0)
        place = column // features
        total = totals[np.searchsorted(places, place)]
        worth = lambda x: x[:, 0] ** 2 / (x[:, 1] + ridge)
        whole = worth(total / UNIT)
        a, b = [], []
        for left in (up, up + total - told):  # absent rows to the right, to the left
            x, y = left / UNIT, (total - left) / UNIT
            a.append(np.where((x[:, 1] >= least) & (y[:, 1] >= least), worth(x) + worth(y) - whole, 0.0))
            b.append(left)
        absent_left = a[1] > a[0]
        gain = np.where(absent_left, a[1], a[0])
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        most = np.maximum.reduceat(gain, start)
        hits = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(start, len(k)))))
        for i in hits[np.concatenate(([True], place[hits][1:] != place[hits][:-1]))]:  # the first of a place
            if gain[i] > LEAST_GAIN:
                p = int(place[i])
                out[p] = (p, float(gain[i]), int(column[i] % features), int(k[i] % BINS), bool(absent_left[i]), (b[int(absent_left[i])][i] / UNIT).tolist(), out[p][6])
    return list(out.values())


def _best(features: int, nodes: int, ridge: float, least: float):
    def run(batches):
        for keys, sums in _parts_of(batches, 2):
            found = split_gains(keys, sums, features, ridge, least)
            if found:
                place, gain, feature, b, absent, left, both = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([p // nodes for p in place], pa.int32()), pa.array([p % nodes for p in place], pa.int32()), pa.array(gain), pa.array(feature, pa.int32()), pa.array(b, pa.int32()), pa.array(absent), pa.array(left, pa.list_(pa.float64())), pa.array(both, pa.list_(pa.float64()))], [x.split()[0] for x in _BEST.split(", ")])

    return run


def _advance(spec: Spec, told):
    def run(batches):
        m = told.value
        for batch in batches:
            scores = _Binned(batch, spec).after(m, len(m.feature))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array([x.tobytes() for x in scores], pa.binary())], batch.schema.names)

    return run


def fit_boosted(data: Problems, rounds: int = 100, depth: int = 6, rate: float = 0.1, rows: float = 0.8, columns: float = 0.5, ridge: float = 1.0, least: float = 1.0, seed: int = 42) -> Boosted:
    """Trees of every fold's model: a tree a class in each round, on a draw of the rows (share rows) and of the tree's columns (share columns).

    A leaf holds -rate * gradient / (curvature + ridge); a child's curvature is at least least.  Rows without a label, of the
    protected fold or of the fold that a model validates train nothing.  A fold without training rows has trees of one leaf, 0.
    """
    spec, spark = data.spec, data.spark
    cores, trees, inner = spark.sparkContext.defaultParallelism, len(spec.folds) * spec.classes, 2**depth - 1
    parts, nodes = min(PARTS, 2 * cores), 2 ** (depth + 1)
    idf = spark.sparkContext.broadcast(data.idf)
    m = Boosted(spec, _cuts(data, parts, idf), depth, np.full((rounds, trees, inner), -1, np.int32), np.zeros((rounds, trees, inner), np.int32), np.zeros((rounds, trees, inner), bool), np.zeros((rounds, trees, 2 * inner + 1)), np.zeros((rounds, trees, inner)))
    table = materialize(_binned(data, m.cuts, data.scaled), "boosting-rows").persist()
    written, enough = 0, int(np.ceil(least * UNIT))
    for r in range(rounds):
        if r - written == KEEP:
            told = spark.sparkContext.broadcast(m.part(written, r))
            new = materialize(table.mapInArrow(_advance(spec, told), table.schema), "boosting-rows")
            table.unpersist()
            discard(table)
            told.unpersist()
            table, written = new.persist(), r
        first = (seed << 32) + r * (trees + 1)
        told = spark.sparkContext.broadcast((m.part(written, r), r - written, first))
        weighed = table.mapInArrow(_curvatures(spec, told, rows, enough), "tree int, sums binary").repartition(cores, "tree").mapInArrow(_able(enough), "tree int, bits binary")
        picks = np.zeros((trees, -(-spec.features // 8)), np.uint8)
        for b in weighed.collect():  # a bit a tree and column
            picks[b["tree"]] = np.frombuffer(b["bits"], np.uint8) & np.packbits(_drawn(np.arange(spec.features, dtype=np.uint64), first + 1 + b["tree"], columns))
        told.unpersist()
        for level in range(depth):
            told = spark.sparkContext.broadcast((m.part(written, r + 1), r - written, level, first, picks))
            sums = table.mapInArrow(_histograms(spec, told, parts, nodes, rows), _SUMS).repartition(cores, "part")
            found: dict[tuple[int, int], tuple] = {}
            for b in sums.mapInArrow(_best(spec.features, nodes, ridge, least), _BEST).collect():  # a row a node and task
                key, rank = (b["tree"], b["node"]), (-b["gain"], b["feature"], b["bin"], b["absent_left"])
                if key not in found or rank < found[key][0]:
                    found[key] = rank, b
            told.unpersist()
            grown = False
            for (t, n), (_, b) in found.items():
                leaf = lambda x: -rate * x[0] / (x[1] + ridge)
                m.value[r, t, n] = leaf(b["all"])
                if b["gain"] > 0:
                    grown = True
                    m.feature[r, t, n], m.bin[r, t, n], m.absent_left[r, t, n], m.gain[r, t, n] = b["feature"], b["bin"], b["absent_left"], b["gain"]
                    m.value[r, t, 2 * n + 1] = leaf(b["left"])
                    m.value[r, t, 2 * n + 2] = leaf([x - y for x, y in zip(b["all"], b["left"], strict=True)])
            if not grown:
                break
    table.unpersist()
    discard(table)
    return m


def _predicted(spec: Spec, told, own_fold: bool):
    def run(batches):
        m, k = told.value, spec.classes
        for batch in batches:
            b = _Binned(batch, spec)
            s = b.after(m, len(m.feature)).reshape(b.n, len(spec.folds), k)
            which = np.full(b.n, len(spec.folds) - 1)
            if own_fold:
                for p, f in enumerate(spec.folds):
                    which[b.fold == f] = p
            own = s[np.arange(b.n), which]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("fold"), batch.column("label"), pa.array(own.argmax(1), pa.int32()), pa.array(_softmax(own).max(1) if b.n else np.zeros(0), pa.float64())], ["doc", "fold", "label", "prediction", "confidence"])

    return run


def predict_boosted(data: Problems, m: Boosted, rows: DataFrame | None = None, own_fold: bool = True) -> DataFrame:
    """(doc, fold, label, prediction, confidence), as crossval.predict: each row by the model that its fold did not train."""
    scaled = data.scaled if rows is None else data.scale(rows)
    if own_fold:
        scaled = scaled.where(F.col("fold").isin(list(m.spec.folds)))
    told = data.spark.sparkContext.broadcast(m.part(0, len(m.feature)))
    schema = StructType([*scaled.select("doc", "fold", "label").schema.fields, StructField("prediction", IntegerType()), StructField("confidence", DoubleType())])
    return _binned(data, m.cuts, scaled).mapInArrow(_predicted(m.spec, told, own_fold), schema)


def tree_rows(m: Boosted) -> list[tuple]:
    """(round, fold, class, node, feature, bin, absent_left, gain, value) of every node that splits or ends a path."""
    out, k = [], m.spec.classes
    for r, t in np.ndindex(m.feature.shape[:2]):
        reached = [0]
        for n in reached:
            split = n < m.feature.shape[2] and m.feature[r, t, n] >= 0
            if split:
                reached += [2 * n + 1, 2 * n + 2]
                out.append((r, m.spec.folds[t // k], t % k, n, int(m.feature[r, t, n]), int(m.bin[r, t, n]), bool(m.absent_left[r, t, n]), float(m.gain[r, t, n]), None))
            else:
                out.append((r, m.spec.folds[t // k], t % k, n, None, None, None, None, float(m.value[r, t, n])))
    return out
