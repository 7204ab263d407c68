"""Classifier families: naive Bayes as aggregates, and Spark ML for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import softmax
from tessera.operators.folds import split
from tessera.operators.tables import materialize

SEED = 42
# fixed values: the configurations that are compared
LOGISTIC = {"logistic_regression_c0_5": 0.5, "logistic_regression_c1": 1.0, "logistic_regression_c2": 2.0, "logistic_regression_c1_balanced": 1.0}
SVM = {"linear_svm_c0_5": 0.5, "linear_svm_c1": 1.0, "linear_svm_c2": 2.0, "linear_svm_c1_balanced": 1.0}
MODELS = ("multinomial_nb", *LOGISTIC, *SVM, "random_forest", "xgboost")


def build_model(model_id: str, rows: int):
    """An unfitted classifier over (features, label, weight); rows: the sum of weights, which scales C."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if model_id == "multinomial_nb":
        return NaiveBayes(modelType="multinomial", smoothing=1.0, **common)
    if model_id in LOGISTIC:
        return LogisticRegression(family="multinomial", regParam=1 / (LOGISTIC[model_id] * rows), standardization=False, maxIter=1000, weightCol="weight", **common)
    if model_id in SVM:
        return OneVsRest(classifier=LinearSVC(regParam=1 / (SVM[model_id] * rows), standardization=False, maxIter=100, weightCol="weight", **common), weightCol="weight", **common)
    if model_id == "random_forest":
        return RandomForestClassifier(numTrees=75, maxDepth=30, featureSubsetStrategy="sqrt", seed=SEED, **common)
    if model_id == "xgboost":
        return OneVsRest(classifier=GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=SEED, **common), **common)
    raise ValueError(f"unknown model: {model_id}")


def with_weights(df: DataFrame, balanced: bool) -> DataFrame:
    """weight: 1, or rows / (classes * rows of the class)."""
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    sizes = df.groupBy("label").agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return df.join(sizes.crossJoin(total), "label").withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def confidence(df: DataFrame) -> Column:
    """The largest probability; of models with scores alone, that of their softmax."""
    if "probability" in df.columns:
        return F.array_max(vector_to_array("probability"))
    if "rawPrediction" in df.columns:
        return F.array_max(softmax(vector_to_array("rawPrediction")))
    return F.lit(float("nan"))


def fit_predict(train: DataFrame, valid: DataFrame, model_id: str) -> DataFrame:
    """valid (doc, features, label) with prediction and confidence."""
    weighted = with_weights(train, model_id.endswith("balanced")).cache()
    out = build_model(model_id, weighted.count()).fit(weighted).transform(valid)
    weighted.unpersist()
    return out.select("doc", "label", "prediction", confidence(out).alias("confidence"))


def cross_validate(df: DataFrame, model_id: str, folds=(1, 2, 3, 4), fold_col: str = "fold") -> DataFrame:
    """Pooled out-of-fold rows (doc, fold, label, prediction, confidence) of df (doc, features, label, fold)."""
    out = None
    for f in folds or (1, 2, 3, 4):
        part = fit_predict(*split(df, f, fold_col), model_id).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def nb_fit(sums: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(terms, priors) of multinomial naive Bayes from sums (label, term, n) and labels (doc, label).

    terms: (label, term, log_p) of seen pairs; priors: (label, log_prior, log_unseen).
    """
    seen = materialize(sums, "seen")
    width = seen.select("term").distinct().count()
    totals = seen.groupBy("label").agg(F.sum("n").alias("total"))
    docs = labels.groupBy("label").agg(F.count("*").alias("docs"))
    everything = docs.agg(F.sum("docs").alias("all_docs"))
    priors = docs.join(totals, "label", "left").crossJoin(everything).select("label", F.log(F.col("docs") / F.col("all_docs")).alias("log_prior"), F.log(F.lit(alpha) / (F.coalesce("total", F.lit(0)) + alpha * width)).alias("log_unseen"), (F.coalesce("total", F.lit(0)) + alpha * width).alias("mass"))
    terms = seen.join(priors, "label").select("label", "term", F.log((F.col("n") + alpha) / F.col("mass")).alias("log_p"))
    return terms, priors.select("label", "log_prior", "log_unseen")


def nb_predict(counts: DataFrame, terms: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc, prediction, score): the best class of each document over terms that training saw.

    A term has one row with a gain a class, so counts are joined once and summed once.
    """
    classes = priors.orderBy("label").collect()  # a row a class
    gain = terms.join(F.broadcast(priors), "label").select("term", "label", (F.col("log_p") - F.col("log_unseen")).alias("gain"))
    wide = gain.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("label") == r["label"], F.col("gain"))), F.lit(0.0)).alias(f"g{k}") for k, r in enumerate(classes)])
    sums = counts.join(wide, "term").groupBy("doc").agg(F.sum("tf").alias("size"), *[F.sum(F.col("tf") * F.col(f"g{k}")).alias(f"g{k}") for k in range(len(classes))])
    scores = [F.struct((F.lit(r["log_prior"]) + F.col("size") * F.lit(r["log_unseen"]) + F.col(f"g{k}")).alias("score"), F.lit(r["label"]).alias("label")) for k, r in enumerate(classes)]
    return sums.select("doc", F.array_max(F.array(*scores)).alias("b")).select("doc", F.col("b.label").alias("prediction"), F.col("b.score").alias("score"))
