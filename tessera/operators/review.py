"""Model review: calibration, referral, bootstrap, error pairs, selection, registry and history."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import headline_by

# fixed values: the referral thresholds that are compared
THRESHOLDS = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.70)


def calibration_bins(bins: int = 10) -> list[tuple[float, float]]:
    """[low, low + width): steps of the width from 0, so the float edges decide what falls in none."""
    return [(float(low), float(low) + 1 / bins) for low in np.arange(0, 1, 1 / bins)]


def calibration_error(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """One row: the expected calibration error over ten bins."""
    edges = calibration_bins()
    bin_ = F.coalesce(*[F.when((F.col(confidence) >= lo) & (F.col(confidence) < hi), F.lit(i)) for i, (lo, hi) in enumerate(edges)])
    by_bin = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))
    total = F.sum("n").over(Window.partitionBy())  # eleven rows
    gaps = by_bin.select("bin", (F.col("n") / total * F.abs(F.col("accuracy") - F.col("confidence"))).alias("gap"))
    return gaps.agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("gap")).otherwise(0.0)).alias("ece"))


def referral_curve(df: DataFrame, confidence: str, correct: Column, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, coverage, referred_rate, accuracy_kept): one scan, an aggregate a threshold."""
    n = df.agg(F.count("*").alias("n"), *[x for i, t in enumerate(thresholds) for x in (F.count(F.when(F.col(confidence) >= t, 1)).alias(f"k{i}"), F.count(F.when((F.col(confidence) >= t) & correct, 1)).alias(f"c{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept"), F.col(f"c{i}").alias("right")) for i, t in enumerate(thresholds)]))
    return n.select("n", rows.alias("r")).select("r.threshold", (F.col("r.kept") / F.col("n")).alias("coverage"), (1 - F.col("r.kept") / F.col("n")).alias("referred_rate"), F.when(F.col("r.kept") > 0, F.col("r.right") / F.col("r.kept")).alias("accuracy_kept"))


def referral_scores(df: DataFrame, confidence: str, classes: int, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, coverage, referred_rate, accuracy_kept, macro_f1_kept) of df (truth, prediction, confidence); a threshold that keeps no row has null scores."""
    told = F.array(*[F.lit(t) for t in thresholds])
    total = df.agg(F.count("*").alias("n"))
    kept = headline_by(df.withColumn("threshold", F.explode(F.filter(told, lambda t: F.col(confidence) >= t))), ["threshold"], classes)
    rows = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double").crossJoin(total).join(kept, "threshold", "left")  # a row a threshold
    coverage = F.coalesce("rows", F.lit(0)) / F.col("n")
    return rows.select("threshold", coverage.alias("coverage"), (1 - coverage).alias("referred_rate"), F.col("accuracy").alias("accuracy_kept"), F.col("macro_f1").alias("macro_f1_kept"))


def bootstrap_difference(df: DataFrame, labels: list[str], truth: str, primary: str, backup: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: macro-F1 difference of two models on the same resampled rows, with its 95 % interval.

    A resample of rows is a multinomial draw over the cells (truth, primary, backup), of
    which there are at most labels cubed; only those counts reach the driver.
    """
    at, k = {x: i for i, x in enumerate(labels)}, len(labels)
    cells = df.groupBy(truth, primary, backup).agg(F.count("*").alias("n")).orderBy(truth, primary, backup).collect()
    n = np.array([r["n"] for r in cells], float)
    draws = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), resamples)

    def f1(counts: np.ndarray, column: str) -> np.ndarray:
        place = np.zeros((len(cells), k * k))
        for i, r in enumerate(cells):
            place[i, at[r[truth]] * k + at[r[column]]] = 1
        m = (counts @ place).reshape(-1, k, k)
        hit, both = np.diagonal(m, axis1=1, axis2=2), m.sum(1) + m.sum(2)
        return np.where(both > 0, 2 * hit / np.maximum(both, 1), 0).mean(1)

    diff = f1(draws, primary) - f1(draws, backup)
    point = float((f1(n[None], primary) - f1(n[None], backup))[0])
    low, high = np.quantile(diff, [0.025, 0.975])
    return df.sparkSession.createDataFrame([(point, float(low), float(high), resamples)], "difference double, low double, high double, resamples int")


def error_pairs(cells: DataFrame) -> DataFrame:
    """Off-diagonal cells, most first; ties in label order."""
    return cells.where("truth <> prediction").orderBy(F.desc("n"), "truth_idx", "prediction_idx")


def best(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the highest score, the first of equals."""
    return df.orderBy(F.desc(score), order).limit(1)


def select_backup(scores: DataFrame, primary: str, family: str, margin: float = 0.005) -> DataFrame:
    """The best model of a family whose score is at most margin under the primary's."""
    p = scores.where(F.col("model") == primary).select(F.col("score").alias("p"))
    return best(scores.crossJoin(p).where(F.col("model").startswith(family) & (F.col("p") - F.col("score") <= margin)), "score", "idx").select("model", "score")


def top_coefficients(df: DataFrame, k: int = 5) -> DataFrame:
    """(class, rank, idx, coefficient): the k largest of each class, ties to the later feature."""
    w = Window.partitionBy("class").orderBy(F.desc("coefficient"), F.desc("idx"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reproduction(current: DataFrame, prior: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(metric, difference, within) of the metrics of either table (metric, value); one that a table lacks is not within."""
    both = current.join(prior.select("metric", F.col("value").alias("prior")), "metric", "full")
    gap = F.abs(F.col("value") - F.col("prior"))
    return both.select("metric", gap.alias("difference"), F.coalesce(gap <= tolerance, F.lit(False)).alias("within"))


def require_reproduced(current: DataFrame, prior: DataFrame, tolerance: float = 1e-6) -> None:
    """Fail closed: raise if a metric differs by more, or only one table has it."""
    row = reproduction(current, prior, tolerance).where("NOT within").first()
    if row is not None:
        raise ValueError(f"not reproduced: {row.asDict()}")


def append_access(history: DataFrame, at: Column) -> DataFrame:
    """The history with one access more: the first, or a reproduction."""
    row = history.agg(F.count("*").alias("n")).select(at.alias("evaluated_at_utc"), F.when(F.col("n") == 0, "first_access").otherwise("reproduction").alias("kind"), F.lit(False).alias("selection_used_final_test"))
    return history.unionByName(row)


def refresh_registry(registry: DataFrame, scores: DataFrame) -> DataFrame:
    """The registry with new scores and sizes in MiB, rounded half to even; a model without a score raises."""
    joined = registry.drop("macro_f1").join(scores, "id", "left")
    score = F.coalesce("macro_f1", F.raise_error(F.concat(F.lit("no score for "), F.col("id"))).cast("double"))
    return joined.withColumns({"macro_f1": score, "size_mib": F.bround(F.col("bytes") / 1048576, 2)})


def registry_checks(registry: DataFrame, default: str, models: int = 5) -> DataFrame:
    t = F.col("referral_threshold")
    return registry.agg((F.count_distinct("id") == models).alias("all_ids"), F.max((F.col("id") == default).cast("int")).cast("boolean").alias("has_default"), F.every(t.isNull() | ((t > 0) & (t < 1))).alias("thresholds_valid"))


# fixed values: what a reader of a prediction is told
ASK_TEXT = "Enter some text."
COMPARISON = "Comparison model only; its confidence was not used to set the 45% referral rule."
LOW = "Low confidence: ask a human moderator to review this tweet."
SUGGESTION = "Model suggestion only; a human should make the final decision."


def review_rule(model: Column, default: Column | str, confidence: Column, threshold: float) -> tuple[Column, Column]:
    """(needs review, message): other models than the default always need review."""
    needs = F.when(model == default, confidence < threshold).otherwise(F.lit(True))
    return needs, F.when(model != default, COMPARISON).when(needs, LOW).otherwise(SUGGESTION)


def respond(df: DataFrame, text: Column, model: Column, category: Column, confidence: Column, default: str, threshold: float) -> DataFrame:
    """df with category, confidence (4 places, half to even), needs_human_review and message; blank text is invalid whatever the model."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "") == ""
    needs, message = review_rule(model, default, confidence, threshold)
    return df.withColumns({"category": F.when(blank, "invalid").otherwise(category), "confidence": F.when(blank, 0.0).otherwise(F.bround(confidence, 4)), "needs_human_review": F.when(blank, True).otherwise(needs), "message": F.when(blank, ASK_TEXT).otherwise(message)})
