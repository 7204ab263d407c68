"""Queries that review fitted models: robustness, referral, calibration, transfer, probes, coefficients, leakage, the protected fold, selection and registry.

All read the predictions that stand in the store, and make what it lacks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import crossval, metrics, review
from tessera.plans.catalog import _IDENTITY, LABELS, query, rounded, table
from tessera.plans.models import LR, NB, SCORES, SETTINGS, SVM, Fits, clean_sql, headline_sql, input_store, read_sql

CANDIDATES = (LR, SVM, NB)
CONDITIONS = tuple(T.PERTURBATIONS)


def _out_of_fold(spark: SparkSession, sf_dir: str, *names: str, protected: bool = False) -> DataFrame:
    """Predictions of the development rows, or of the protected fold, by the models named."""
    fits = Fits(spark, sf_dir)
    for m in names:
        fits.model(m)
    fits.close()
    fold = F.col("fold") == crossval.PROTECTED
    return fits.read().where(F.col("model").isin(*names) & (F.col("condition") == "clean") & (fold if protected else ~fold))


def _one(preds: str) -> str:
    """Headline SQL of one set of predictions."""
    return headline_sql(f"SELECT 1 AS k, truth, prediction FROM ({preds})", "k")


_ROBUST = headline_sql(f"SELECT model||':'||condition AS k, truth, prediction FROM {read_sql()} WHERE fold <> 0 AND model IN ('{LR}', '{SVM}') AND condition IN {CONDITIONS}", "k")


@query(f"WITH {_ROBUST}, r AS (SELECT split_part(k, ':', 1) AS model, split_part(k, ':', 2) AS condition, rows, macro_f1 FROM hm) SELECT a.model, a.condition, a.rows, round(a.macro_f1, 9) AS macro_f1, round(a.macro_f1 / b.macro_f1, 9) AS retention FROM r a JOIN r b ON a.model = b.model AND b.condition = 'clean'")
def model_robustness(spark, sf_dir):
    """macro-F1 of two fitted models on the texts as they are and under four perturbations, each row by the model that did not train on its fold."""
    fits = Fits(spark, sf_dir)
    df = fits.frame().where("fold <> 0")
    for m in (LR, SVM):
        fits.model(m)
        for c in CONDITIONS[1:]:
            fits.apply(m, c, df.withColumn("text", T.PERTURBATIONS[c](F.col("text"))))
    fits.close()
    scores = metrics.headline_by(fits.read().where(F.col("model").isin(LR, SVM) & F.col("condition").isin(*CONDITIONS) & (F.col("fold") != 0)), ["model", "condition"], len(LABELS)).select("model", "condition", "rows", "macro_f1")
    clean = scores.where("condition = 'clean'").select("model", F.col("macro_f1").alias("clean"))
    return rounded(scores.join(clean, "model").select("model", "condition", "rows", "macro_f1", (F.col("macro_f1") / F.col("clean")).alias("retention")))


_KEPT = headline_sql(f"SELECT threshold, truth, prediction FROM ({clean_sql(LR)}) JOIN t ON confidence >= threshold", "threshold")


@query(f"WITH t(threshold) AS (SELECT unnest({list(review.THRESHOLDS)})::double), {_KEPT} SELECT threshold, round(coalesce(rows, 0) / (SELECT count(*) FROM ({clean_sql(LR)})), 9) AS coverage, round(1 - coalesce(rows, 0) / (SELECT count(*) FROM ({clean_sql(LR)})), 9) AS referred_rate, round(accuracy, 9) AS accuracy_kept, round(macro_f1, 9) AS macro_f1_kept FROM t LEFT JOIN hm USING (threshold)")
def model_referral(spark, sf_dir):
    """What is kept, and how good it is, at each threshold of the primary model's confidence."""
    return rounded(review.referral_scores(_out_of_fold(spark, sf_dir, LR), "confidence", len(LABELS)))


_BINS = ", ".join(f"({lo!r}::double, {hi!r}::double)" for lo, hi in review.calibration_bins())


@query(f"WITH e(lo, hi) AS (VALUES {_BINS}), p AS ({clean_sql(LR)}), b AS (SELECT lo, count(*) AS n, avg((truth = prediction)::int) AS a, avg(confidence) AS c FROM p JOIN e ON confidence >= lo AND confidence < hi GROUP BY lo) SELECT round(sum(n / (SELECT count(*) FROM p) * abs(a - c)), 9) AS ece, round((SELECT avg(confidence) FROM p), 9) AS mean_confidence FROM b")
def model_calibration(spark, sf_dir):
    """Expected calibration error and mean confidence of the primary model's out-of-fold predictions."""
    p = _out_of_fold(spark, sf_dir, LR)
    mean = p.agg(F.avg("confidence").alias("mean_confidence"))
    return rounded(review.calibration_error(p, "confidence", F.col("truth") == F.col("prediction")).crossJoin(mean))  # a row each


@query(f"WITH {_one(clean_sql(LR, 'fold = 0'))}, p AS ({clean_sql(LR, 'fold = 0')}) SELECT rows, round(accuracy, 9) AS accuracy, round(balanced_accuracy, 9) AS balanced_accuracy, round(macro_f1, 9) AS macro_f1, round(mcc, 9) AS mcc, round((SELECT avg(confidence) FROM p), 9) AS mean_confidence, round((SELECT avg((confidence < 0.45)::int) FROM p), 9) AS referred_rate FROM hm")
def protected_fold(spark, sf_dir):
    """The final evaluation: the model of all development rows on the fold that none has trained on."""
    p = _out_of_fold(spark, sf_dir, LR, protected=True)
    told = p.agg(F.avg("confidence").alias("mean_confidence"), F.avg((F.col("confidence") < 0.45).cast("double")).alias("referred_rate"))
    return rounded(metrics.headline_by(p, [], len(LABELS)).select("rows", *SCORES).crossJoin(told))  # a row each


_LEAKS = headline_sql(f"SELECT condition AS k, truth, prediction FROM {read_sql()} WHERE model = '{LR}' AND fold <> 0 AND condition IN ('clean', 'random_folds')", "k")


@query(f"WITH {_LEAKS} SELECT CASE k WHEN 'clean' THEN 'grouped' ELSE 'random' END AS folds, rows, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(macro_f1 - (SELECT macro_f1 FROM hm WHERE k = 'clean'), 9) AS gain FROM hm")
def leakage_scores(spark, sf_dir):
    """The primary model's score with folds that keep groups whole, and with random ones: what leaks between copies is the gain."""
    grouped = _out_of_fold(spark, sf_dir, LR)
    fits = Fits(spark, sf_dir, "random")
    fits.model(LR)
    fits.close()
    other = fits.read().where((F.col("model") == LR) & (F.col("condition") == "random_folds") & (F.col("fold") != 0))
    both = grouped.select(F.lit("grouped").alias("folds"), "truth", "prediction").unionByName(other.select(F.lit("random").alias("folds"), "truth", "prediction"))
    scores = metrics.headline_by(both, ["folds"], len(LABELS)).select("folds", "rows", "accuracy", "macro_f1")
    base = scores.where("folds = 'grouped'").select(F.col("macro_f1").alias("base"))
    return rounded(scores.crossJoin(base).select("folds", "rows", "accuracy", "macro_f1", (F.col("macro_f1") - F.col("base")).alias("gain")))  # a row


def _external(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """Conversation turns, predicted by the model of all development rows."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", F.lit(None).cast("int").alias("number"), F.lit(0).alias("fold"))
    fits = Fits(spark, sf_dir)
    fits.model(model)
    fits.apply(model, "conversations", turns, own_fold=False, kind="external")
    fits.close()
    return fits.read("external").where((F.col("model") == model) & (F.col("condition") == "conversations"))


_TRANSFER = f"SELECT model, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t AND p) AS tp FROM (SELECT model, role <> 'user' AS t, prediction <> 'en' AS p FROM {read_sql('external')} JOIN conversations ON doc = conv_id * 1000 + turn WHERE condition = 'conversations' AND model IN ('{LR}', '{SVM}')) GROUP BY model"
_DIV = "CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"


@query(f"SELECT model, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(({_DIV.format(a='2 * tp', b='(2 * tp + fp + fn)')} + {_DIV.format(a='2 * tn', b='(2 * tn + fp + fn)')}) / 2, 9) AS macro_f1, round({_DIV.format(a='tp', b='(tp + fp)')}, 9) AS precision, round({_DIV.format(a='tp', b='(tp + fn)')}, 9) AS recall, round({_DIV.format(a='fp', b='(tn + fp)')}, 9) AS false_positive_rate FROM ({_TRANSFER})")
def model_transfer(spark, sf_dir):
    """Two fitted models on another table: every class but one counts as positive, held against a binary truth."""
    out = None
    for m in (LR, SVM):
        got = _external(spark, sf_dir, m).join(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "role"), "doc")
        part = metrics.binary_metrics(got, F.col("role") != "user", F.col("prediction") != "en").select(F.lit(m).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


_PROBES = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_IDENTITY))


@query(f"SELECT category, term, 'this person is '||lower(term)||'.' AS sentence, prediction, round(confidence, 9) AS confidence FROM (VALUES {_PROBES}) t(doc, category, term) JOIN {read_sql('external')} USING (doc) WHERE condition = 'probes' AND model = '{LR}'")
def identity_probes(spark, sf_dir):
    """What the fitted model says of sentences that differ in one term."""
    probes = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(_IDENTITY)], "row_id long, category string, term string").withColumn("text", F.concat(F.lit("This person is "), "term", F.lit(".")))
    fits = Fits(spark, sf_dir)
    fits.model(LR)
    fits.apply(LR, "probes", probes.select("row_id", "text", F.lit(None).cast("int").alias("number"), F.lit(0).alias("fold")), own_fold=False, kind="external")
    fits.close()
    got = fits.read("external").where((F.col("model") == LR) & (F.col("condition") == "probes"))
    return rounded(probes.join(got, F.col("row_id") == F.col("doc")).select("category", "term", T.profile_p1(F.col("text")).alias("sentence"), "prediction", "confidence"))


@query(f"WITH c AS (SELECT * FROM {read_sql('coefficients')} WHERE model = '{LR}'), t AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY coefficient DESC, idx DESC)::int AS rank FROM c) SELECT class, rank, idx, round(coefficient, 9) AS coefficient, block||'__'||left(term, 1)||repeat('*', greatest(2, length(term) - 1)) AS masked_feature FROM t WHERE rank <= 5")
def model_coefficients(spark, sf_dir):
    """The five largest coefficients of each class of the final model, their terms masked but for the first character."""
    fits = Fits(spark, sf_dir)

    def make() -> dict:
        fitted, k = fits.model(LR), len(LABELS)
        final = fitted.weights[-k:]  # of the protected fold
        used = np.flatnonzero(fits.features.idf[-1] > 0)
        told = pd.DataFrame({"class": np.repeat(LABELS, len(used)), "idx": np.tile(used, k).astype(np.int32), "coefficient": final[:, used].ravel()})
        vocabulary = fits.features.table.select("idx", "block", "term")
        fits.store.write(spark.createDataFrame(told, "class string, idx int, coefficient double").join(vocabulary, "idx"), "coefficients", f"model={LR}", "condition=clean")
        return {}

    fits.store.once("coefficients", SETTINGS, make)
    top = review.top_coefficients(fits.read("coefficients").where(F.col("model") == LR))
    return rounded(top.select("class", "rank", "idx", "coefficient", F.concat("block", F.lit("__"), T.mask_feature(F.concat("block", F.lit("__"), "term"))).alias("masked_feature")))


@query(f"SELECT truth, prediction, count(*) AS n FROM {read_sql()} WHERE model = '{LR}' AND condition = 'clean' AND fold <> 0 GROUP BY ALL")
def model_confusion(spark, sf_dir):
    """How often the primary model takes each class for each."""
    return _out_of_fold(spark, sf_dir, LR).groupBy("truth", "prediction").agg(F.count("*").alias("n"))


# --- selection and registry -------------------------------------------------------------------------

_BY_FOLD = headline_sql(f"SELECT model||':'||fold AS k, truth, prediction FROM {read_sql()} WHERE condition = 'clean' AND fold <> 0", "k")
_SCORED = f"{_BY_FOLD}, s AS (SELECT split_part(k, ':', 1) AS model, avg(macro_f1) AS score, list_position({list(CANDIDATES)}, split_part(k, ':', 1)) - 1 AS idx FROM hm GROUP BY ALL)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, score, idx): mean macro-F1 over the folds of the models that are compared."""
    by = metrics.headline_by(_out_of_fold(spark, sf_dir, *CANDIDATES), ["model", "fold"], len(LABELS))
    return by.groupBy("model").agg(F.avg("macro_f1").alias("score")).withColumn("idx", (F.array_position(F.array(*map(F.lit, CANDIDATES)), F.col("model")) - 1).cast("int"))


@query(f"WITH {_SCORED} SELECT model, round(s.score, 9) AS score FROM s ORDER BY s.score DESC, idx LIMIT 1")
def winner(spark, sf_dir):
    """The candidate of the highest mean score over the folds."""
    return rounded(review.best(_scores(spark, sf_dir), "score", "idx").select("model", "score"))


@query(f"WITH {_SCORED} SELECT model, round(s.score, 9) AS score FROM s WHERE model LIKE 'linear_svm%' AND (SELECT score FROM s WHERE idx = 0) - s.score <= 0.05 ORDER BY s.score DESC, idx LIMIT 1")
def candidate_selection(spark, sf_dir):
    """The backup: the best SVM whose score is close to the primary's."""
    return rounded(review.select_backup(_scores(spark, sf_dir), LR, "linear_svm", 0.05))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bytes, referral_threshold, macro_f1) of the models in the store: the size of their weights, and no score yet."""
    fits = Fits(spark, sf_dir)
    for m in CANDIDATES:
        fits.model(m)
    fits.close()
    store, out = input_store(spark, sf_dir), None
    for m in CANDIDATES:
        part = store.read("weights", f"group-{m}").agg(F.sum(F.octet_length("weights")).cast("long").alias("bytes")).select(F.lit(m).alias("id"), "bytes", F.lit(0.45 if m == LR else None).cast("double").alias("referral_threshold"), F.lit(0.0).alias("macro_f1"))
        out = part if out is None else out.unionByName(part)
    return out


_REGISTRY = f"(SELECT id, sum(octet_length(weights))::bigint AS bytes, CASE WHEN id = '{LR}' THEN 0.45 END AS referral_threshold FROM (SELECT regexp_extract(filename, 'group-([a-z0-9_]+)/', 1) AS id, weights FROM {read_sql('weights', at='group-*')}) GROUP BY id)"


@query(f"WITH {_SCORED} SELECT id, round(s.score, 9) AS macro_f1, round(bytes / 1048576, 2) AS size_mib FROM {_REGISTRY} r JOIN s ON s.model = r.id")
def registry_refresh(spark, sf_dir):
    """The registry of the fitted models with their scores and sizes."""
    scores = _scores(spark, sf_dir).select(F.col("model").alias("id"), F.col("score").alias("macro_f1"))
    return rounded(review.refresh_registry(_registry(spark, sf_dir), scores).select("id", "macro_f1", "size_mib"))


@query(f"SELECT count(DISTINCT id) = 3 AS all_ids, bool_or(id = '{LR}') AS has_default, bool_and(referral_threshold IS NULL OR (referral_threshold > 0 AND referral_threshold < 1)) AS thresholds_valid FROM {_REGISTRY}")
def registry_checks(spark, sf_dir):
    return review.registry_checks(_registry(spark, sf_dir), LR, 3)


@query(f"WITH {_one(clean_sql(LR))}, now AS (SELECT unnest([{{'metric': 'accuracy', 'value': accuracy}}, {{'metric': 'balanced_accuracy', 'value': balanced_accuracy}}, {{'metric': 'macro_f1', 'value': macro_f1}}, {{'metric': 'mcc', 'value': mcc}}], recursive := true) FROM hm), r AS (SELECT metric, value AS prior FROM {read_sql('records')} WHERE model = '{LR}' AND condition = 'clean') SELECT metric, abs(value - prior) <= 1e-6 AS within FROM now JOIN r USING (metric)")
def reproduction_tolerance(spark, sf_dir):
    """The scores that were recorded when the model was fitted, against those of the predictions that stand in the store."""
    p = _out_of_fold(spark, sf_dir, LR)
    now = metrics.headline_by(p, [], len(LABELS)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in SCORES])).alias("m")).select("m.*")
    prior = Fits(spark, sf_dir).read("records").where((F.col("model") == LR) & (F.col("condition") == "clean")).select("metric", "value")
    return review.reproduction(now, prior).select("metric", "within")
