"""A text classifier from raw text to label names: fitted, evaluated by folds, saved with a manifest, and loaded only if it is whole."""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.functions.text import PROFILES
from tessera.operators import metrics
from tessera.operators.features import TallTfidf, assemble
from tessera.operators.folds import oversample, split
from tessera.operators.models import build_model, confidence, with_weights
from tessera.sources.files import file_hashes


class TextClassifier:
    """Profile, TF-IDF blocks and a classifier in one; labels are encoded in alphabetical order and come back as names."""

    def __init__(self, model_id: str, representation: str = "combined", profile: str = "p1", word_max_features: int = 60_000, character_max_features: int = 60_000):
        self.settings = {"model_id": model_id, "representation": representation, "profile": profile, "word_max_features": word_max_features, "character_max_features": character_max_features}
        self.features = TallTfidf(representation, PROFILES[profile], word_max_features, character_max_features)
        self.model: PipelineModel | None = None
        self.labels: list[str] = []

    def _vectors(self, df: DataFrame, tall: DataFrame, key: str) -> DataFrame:
        """df with features; a text without a known term has a vector of zeros."""
        vectors = assemble(tall, self.names).withColumnRenamed("doc", key)
        zero = df.sparkSession.createDataFrame([(SparseVector(self.n_features, [], []),)], StructType([StructField("_zero", VectorUDT())]))
        return df.join(vectors, key, "left").crossJoin(F.broadcast(zero)).withColumn("features", F.coalesce("features", "_zero")).drop("_zero")  # one row

    def fit(self, df: DataFrame, key: str, text: str, label: str) -> TextClassifier:
        tall = self.features.fit_transform(df, key, text)
        self.names = self.features.names().cache()  # the capped vocabulary
        rows = self._vectors(df.select(key, F.col(label).alias("name")), tall, key)
        indexer = StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
        weighted = with_weights(indexer.transform(rows), self.settings["model_id"].endswith("balanced"))
        fitted = build_model(self.settings["model_id"], weighted.count()).fit(weighted)
        self.labels = list(indexer.labels)
        self.model = PipelineModel([fitted, IndexToString(inputCol="prediction", outputCol="category", labels=self.labels)])
        return self

    @property
    def n_features(self) -> int:
        return self.names.count()

    def predict(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """df with category and confidence."""
        out = self.model.transform(self._vectors(df, self.features.transform(df, key, text), key))
        return out.select(*df.columns, "category", confidence(out).alias("confidence"))

    def save(self, path: str, spark: SparkSession) -> dict:
        """Write vocabularies, model and labels under path, and a manifest with the checksum of every file; the manifest is returned."""
        for block, vocab in self.features.vocabularies.items():
            vocab.write.mode("overwrite").parquet(f"{path}/vocabulary/{block}")
        self.model.write().overwrite().save(f"{path}/model")
        manifest = {"settings": self.settings, "labels": self.labels, "files": _checksums(spark, path)}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}-manifest")
        return manifest


def _checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """The checksum of each data file under path, by its name in the folder; there are as many as a model has parts."""
    files = file_hashes(spark.newSession(), path, recursive=True).where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
    return {r["path"].split(path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[1]: r["sha256"] for r in files.collect()}


def load_classifier(spark: SparkSession, path: str, labels: list[str] | None = None) -> TextClassifier:
    """A saved classifier; a file that is missing, more or changed, or other labels than those given, raise."""
    manifest = json.loads(spark.read.text(f"{path}-manifest").first()[0])
    if _checksums(spark, path) != manifest["files"]:
        raise ValueError(f"the classifier at {path} is not the one that was saved")
    if labels is not None and set(labels) != set(manifest["labels"]):
        raise ValueError("the model's classes are not the expected ones")
    out = TextClassifier(**manifest["settings"])
    out.labels = manifest["labels"]
    out.features.vocabularies = {b: spark.read.parquet(f"{path}/vocabulary/{b}") for b in out.features.blocks}
    out.names = out.features.names().cache()
    out.model = PipelineModel.load(f"{path}/model")
    return out


def evaluate_candidate(df: DataFrame, labels: DataFrame, model_id: str, key: str, text: str, label: str, folds: tuple[int, ...] = (1, 2, 3, 4), fold_col: str = "fold", oversampled: bool = False, **settings) -> tuple[DataFrame, list[dict]]:
    """(pooled out-of-fold rows (key, fold, truth, prediction, confidence), a record a fold with metrics, features and seconds).

    Features and model are fitted on the other folds alone; fold 0 is in none.  oversampled
    draws every class of the training rows to the size of the largest.
    """
    pooled, records = None, []
    for f in folds:
        train, valid = split(df, f, fold_col)
        if oversampled:
            drawn = oversample(train.select(key, text, label), label, key)
            train = drawn.withColumn("_copy", F.monotonically_increasing_id()).withColumn(key, F.concat_ws("#", F.col(key).cast("string"), F.col("_copy").cast("string"))).drop("_copy")
        begin = time.time()
        fitted = TextClassifier(model_id, **settings).fit(train, key, text, label)
        between = time.time()
        got = fitted.predict(valid.select(key, text, F.col(label).alias("truth")), key, text).select(key, F.lit(f).alias("fold"), "truth", F.col("category").alias("prediction"), "confidence").cache()
        scores = metrics.headline(metrics.confusion(got, labels)).first().asDict()
        records.append({"fold": f, "model": model_id, **scores, "features": fitted.n_features, "train_seconds": between - begin, "predict_seconds": time.time() - between})
        pooled = got if pooled is None else pooled.unionByName(got)
    return pooled, records


def robustness(fitted: TextClassifier, df: DataFrame, labels: DataFrame, perturbations: dict, key: str, text: str, label: str) -> DataFrame:
    """(condition, macro_f1, retention) of a classifier on texts as they are and perturbed; retention is against "clean"."""
    out = []
    for name, change in perturbations.items():
        got = fitted.predict(df.select(key, change(F.col(text)).alias(text), F.col(label).alias("truth")), key, text)
        out.append((name, metrics.headline(metrics.confusion(got.withColumnRenamed("category", "prediction"), labels)).first()["macro_f1"]))
    clean = dict(out)["clean"]
    return df.sparkSession.createDataFrame([(n, float(v), float(v) / clean if clean else 0.0) for n, v in out], "condition string, macro_f1 double, retention double")


def transfer(fitted: TextClassifier, df: DataFrame, key: str, text: str, truth: Column, harmless: str) -> DataFrame:
    """Binary figures of a classifier on another table: every category but harmless counts as harmful."""
    got = fitted.predict(df.withColumn("_truth", truth), key, text)
    return metrics.binary_metrics(got, F.col("_truth"), F.col("category") != harmless)
