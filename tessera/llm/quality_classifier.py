"""Operator 7: a compression classifier.

Zstandard dictionaries are built from good and from bad labelled texts.  A text is
compressed with either; the difference of the sizes over their sum says which
dictionary knows it better.  A logistic curve fitted on labelled texts that are in
neither dictionary calibrates it; beside the difference it takes the compressed share
of the text, since text that repeats itself needs no dictionary and leaves no difference.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import crc32_rest, materialize, small_batches, table, text_buffer


class Limits(NamedTuple):
    """Bounds of what the driver holds to fit the classifier."""

    texts: int = 1500  # labelled texts of each class, half for dictionaries and half for calibration
    sample_bytes: int = 12 << 20  # of the texts, whole ones in the order of a hash, that a dictionary is built from; one that does not fit is passed over
    dictionary_bytes: int = 65536
    level: int = 3
    fold: int = 3  # labels are learned from ids whose crc32 modulo fold is not held
    held: int = 1


class Model(NamedTuple):
    good: bytes
    bad: bytes
    level: int
    curve: tuple[float, ...]  # scale and weight of each feature, then the offset


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the texts themselves."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b"\n" * 8


def _compressors(model: Model):
    # one of each for a task: they keep their digested dictionaries
    return [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]


def features(texts: list, model: Model) -> np.ndarray:
    """A row each: (size with the bad dictionary - with the good one) / their sum, and the log share of the text that either leaves."""
    good, bad = _compressors(model)
    sizes = np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], float).reshape(-1, 3)
    both = np.maximum(sizes[:, 0] + sizes[:, 1], 1)
    return np.stack(((sizes[:, 1] - sizes[:, 0]) / both, np.log(both / (2 * np.maximum(sizes[:, 2], 1)))), 1)


def curve_scores(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(curve[:-1]) + curve[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> tuple[float, ...]:
    """Weights and offset by Newton's method, classes weighted alike."""
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        return (0.0,) * width + ((0.0 if not len(y) else 4.0 if y[0] else -4.0),)
    scale = np.append(np.where(x.std(0) > 0, x.std(0), 1.0), 1.0)
    z = np.column_stack((x, np.ones(len(x)))) / scale
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    ridge = penalty * np.append(np.ones(width), 1e-6)
    b = np.zeros(width + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (weight * (p - y)) + ridge * b)
        b -= np.clip(step, -4, 4)
        if abs(step).max() < 1e-9:
            break
    return tuple((b / scale).tolist())


def fit_quality(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most limits.texts labelled rows of each class, chosen by a hash of the id.

    Rows without a text or label, and ids held out, are left out; an id of several
    labels counts with each.  No rows of one class make a model that always says the other.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    known = known.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(limits.fold)) != limits.held)
    order = F.xxhash64(F.col("id").cast("string"), F.lit(7))
    chosen = known.where("label = 1").orderBy(order, "id").limit(limits.texts).union(known.where("label = 0").orderBy(order, "id").limit(limits.texts))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text")).where("octet_length(text) > 0")
    # at most 2 * texts ids; rows of one id share the bound
    of_class = Window.partitionBy("label").orderBy(order, "id", "text")
    rows = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("id", "label", "text").withColumn("nth", F.row_number().over(of_class)).where(F.col("nth") <= limits.texts)
    rows = materialize(rows.withColumn("all", F.count("*").over(Window.partitionBy("label"))), "labelled")
    first = F.col("nth") <= F.ceil(F.col("all") / 2)
    sample = rows.where(first & (F.octet_length("text") <= limits.sample_bytes)).withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(of_class.rowsBetween(Window.unboundedPreceding, 0)))
    built: dict = {0: [], 1: []}
    for r in sample.where(F.col("upto") <= limits.sample_bytes).orderBy("label", "nth").select("label", "text").collect():  # 2 * sample_bytes at most
        built[r["label"]].append(bytes(r["text"]))
    model = Model(*(_dictionary(built[c], limits.dictionary_bytes) for c in (1, 0)), limits.level, ())
    # two numbers a row come back; a class of one text is calibrated on that
    got = rows.where(~first | (F.col("all") == 1)).select("label", "text").mapInArrow(_measure(model), "label int, x array<double>").collect()
    got.sort(key=lambda r: (r["label"], r["x"]))
    return model._replace(curve=fit_logistic(np.array([r["x"] for r in got]).reshape(-1, 2), np.array([r["label"] for r in got], float)))


def _measure(model: Model):
    def run(batches):
        for batch in batches:
            x = features([t.as_buffer() for t in batch.column(1)], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    return run


def _score(model: Model, limits: Limits):
    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            data = memoryview(buf)
            score = curve_scores(features([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], model), model.curve)
            held = crc32_rest(batch.column(0).to_pylist(), limits.fold) == limits.held
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Model, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, from its whole text.

    A null text scores as the empty one, like any text from its two sizes.  Repeated rows get the same score; a null id counts as the
    empty string in held_out; other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model, limits), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole document, fitted on labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
