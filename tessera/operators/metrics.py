"""Metrics from confusion counts, and distributions of confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, labels: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(truth, prediction, n) over the square of labels (label, idx), zero cells kept."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    square = labels.select(F.col("label").alias("truth"), F.col("idx").alias("truth_idx")).crossJoin(labels.select(F.col("label").alias("prediction"), F.col("idx").alias("prediction_idx")))  # the label domain
    return square.join(counts, ["truth", "prediction"], "left").na.fill(0, ["n"])


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support, predicted) from confusion cells."""
    hit = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
    t = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    p = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    return t.join(p, "label").select("label", _safe(F.col("hits"), F.col("predicted")).alias("precision"), _safe(F.col("hits"), F.col("support")).alias("recall"), _safe(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"), "support", "predicted", "hits")


def headline(cells: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy (classes in truth), macro-F1 (classes seen at all), macro-F1 over all labels, MCC."""
    c = per_class(cells)
    seen = F.col("support") + F.col("predicted") > 0
    sums = c.agg(
        F.sum("hits").alias("c"), F.sum("support").alias("s"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"), F.avg("f1").alias("macro_f1_all"),
        F.sum((F.col("support") * F.col("predicted")).cast("double")).alias("tp"), F.sum((F.col("support") * F.col("support")).cast("double")).alias("tt"), F.sum((F.col("predicted") * F.col("predicted")).cast("double")).alias("pp"),
    )
    s2, low = F.col("s") * F.col("s").cast("double"), F.col("c") * F.col("s").cast("double")
    root = F.sqrt(s2 - F.col("pp")) * F.sqrt(s2 - F.col("tt"))
    return sums.select(_safe(F.col("c"), F.col("s")).alias("accuracy"), "balanced_accuracy", "macro_f1", "macro_f1_all", F.when(root == 0, 0.0).otherwise((low - F.col("tp")) / root).alias("mcc"))


def headline_by(df: DataFrame, by: list[str], classes: int, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(*by, rows, accuracy, balanced_accuracy, macro_f1, macro_f1_all, mcc) of each group of predictions.

    A count of each (truth, prediction) tells a class twice, as truth and as prediction, so one sum a class has
    all its counts; macro_f1_all is over the given number of classes.
    """
    cells = df.groupBy(*by, F.col(truth).alias("_t"), F.col(prediction).alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_t").eqNullSafe(F.col("_p")), F.col("_n")).otherwise(0)
    sides = F.array(F.struct(F.col("_t").alias("label"), F.col("_n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("h")), F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("_n").alias("p"), F.lit(0).cast("long").alias("h")))
    each = cells.select(*by, F.explode(sides).alias("x")).groupBy(*by, F.col("x.label").alias("label")).agg(F.sum("x.s").alias("s"), F.sum("x.p").alias("p"), F.sum("x.h").alias("h"))
    f1 = _safe(2 * F.col("h"), F.col("s") + F.col("p"))
    square = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    sums = each.groupBy(*by).agg(F.sum("s").alias("rows"), F.sum("h").alias("hits"), F.avg(F.when(F.col("s") > 0, F.col("h") / F.col("s"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1) / classes).alias("macro_f1_all"), square("s", "p").alias("sp"), square("s", "s").alias("ss"), square("p", "p").alias("pp"))
    n2 = F.col("rows") * F.col("rows").cast("double")
    root = F.sqrt(n2 - F.col("pp")) * F.sqrt(n2 - F.col("ss"))
    mcc = F.when(root == 0, 0.0).otherwise((F.col("hits").cast("double") * F.col("rows") - F.col("sp")) / root)
    return sums.select(*by, "rows", _safe(F.col("hits"), F.col("rows")).alias("accuracy"), "balanced_accuracy", "macro_f1", "macro_f1_all", mcc.alias("mcc"))


def binary_metrics(df: DataFrame, truth: Column, prediction: Column) -> DataFrame:
    """One row of the four counts and the binary figures of the positive class."""
    cell = lambda a, b: F.count(F.when((truth == F.lit(a)) & (prediction == F.lit(b)), 1))
    n = df.agg(cell(False, False).alias("tn"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(True, True).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    f1 = (_safe(2 * tp, 2 * tp + fp + fn) + _safe(2 * tn, 2 * tn + fp + fn)) / 2
    return n.select("tn", "fp", "fn", "tp", _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), f1.alias("macro_f1"), _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"), _safe(fp, tn + fp).alias("false_positive_rate"))


#: Bins of a pass of exact_quantiles, and rows of a bin that are sorted on the driver.
BINS, FEW = 1024, 10_000


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values that stand at places `ranks`, from 0, in ascending order; nulls and NaN aside.

    A pass counts the rows of equal bins between the smallest and the largest value that are still in
    question, with the smallest and largest of each bin; only bins that hold a place are looked into further,
    until a bin holds one value or few rows.  No task and no driver holds more than bins, or FEW rows.
    """
    x = F.col(value).cast("double")
    found: dict[int, float] = {}
    ends = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")).first()
    spans = {(ends["lo"], ends["hi"], 0, ends["n"]): list(ranks)} if ends["n"] else {}
    while spans:
        deeper: dict[tuple, list[int]] = {}
        for (lo, hi, before, n), places in spans.items():
            inside = df.where((x >= lo) & (x <= hi))
            if lo == hi:
                found |= dict.fromkeys(places, lo)
            elif n <= FEW:
                values = [r[0] for r in inside.select(x).sort(x).collect()]  # FEW at most
                found |= {p: values[p - before] for p in places}
            else:
                bin_ = F.least(F.floor((x - lo) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1))
                for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy("lo").collect():  # BINS at most
                    if own := [p for p in places if before <= p < before + r["n"]]:
                        deeper[r["lo"], r["hi"], before, r["n"]] = own
                    before += r["n"]
        spans = deeper
    return found


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, in bounded memory; of no values null."""
    x = F.col(value).cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * s for s in shares]
    at = order_statistics(df, value, sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}))
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]


def confidence_distribution(df: DataFrame, confidence: str, threshold: float) -> DataFrame:
    """One row: smallest, quartiles, largest and mean, and the share under the threshold."""
    q = exact_quantiles(df, confidence, [0.25, 0.5, 0.75])
    return df.agg(F.min(confidence).alias("min"), *[F.lit(v).cast("double").alias(c) for c, v in zip(("q25", "median", "q75"), q, strict=True)], F.max(confidence).alias("max"), F.avg(confidence).alias("mean"), F.avg((F.col(confidence) < threshold).cast("double")).alias("referred_rate"))


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return folds.agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
