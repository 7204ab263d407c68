"""Data contracts, duplicate audits and class statistics."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import with_rank
from tessera.operators.tables import materialize

MISSING = "<MISSING_LABEL>"


def duplicate_audit(df: DataFrame, text: Column, label: Column) -> DataFrame:
    """One row: label conflicts, groups of equal text and label, and equal whole rows.

    Texts and rows are compared by 128 bits of hash, worked out once in one scan; what is
    shuffled is narrow and already grouped.
    """
    twice = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit(1), *c))
    t1, t2 = twice("text")
    w1, w2 = twice(*df.columns)
    # an xxhash64 passes over nulls, so which columns are null is a part of the row
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    told = df.select(F.struct(w1, w2, nulls).alias("row"), text.alias("text"), F.coalesce(label, F.lit(MISSING)).alias("label"))
    rows = materialize(told.select("row", t1.alias("t1"), t2.alias("t2"), F.col("text").isNull().alias("none"), (F.col("text") == "").alias("empty"), "label"), "rows")
    pairs = rows.groupBy("t1", "t2", "none", "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("empty"), 1)).alias("empty"))
    several = lambda n: F.coalesce(F.sum(F.when(F.col(n) > 1, F.col(n))), F.lit(0))
    by_text = pairs.groupBy("t1", "t2", "none").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("empty").alias("empty"), F.count(F.when(F.col("n") > 1, 1)).alias("groups"), several("n").alias("in_groups"), F.sum(F.col("n") - 1).alias("beyond"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = by_text.agg(none("groups").alias("duplicate_groups"), none("in_groups").alias("duplicate_rows"), none("beyond").alias("beyond_canonical"), F.count(F.when(F.col("labels") > 1, 1)).alias("conflicting_texts"), none(F.when(F.col("labels") > 1, F.col("n"))).alias("conflicting_rows"), none("empty").alias("empty_texts"), none("n").alias("rows"))
    whole = rows.groupBy("row").agg(F.count("*").alias("n"))
    b = whole.agg(several("n").alias("full_row_involved"), none(F.col("n") - 1).alias("full_row_beyond_first"))
    return a.crossJoin(b).select("duplicate_groups", "duplicate_rows", "beyond_canonical", "conflicting_texts", "conflicting_rows", "full_row_involved", "full_row_beyond_first", "empty_texts", "rows")  # a row each


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])


def label_domain(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, idx int")


def invalid_labels(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Labels beyond the domain, null aside."""
    return df.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct().join(F.broadcast(label_domain(df, labels)), "label", "left_anti").select("label")


def class_counts(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # a label of the domain that no row has is refused
    n = F.coalesce("n", F.raise_error(F.concat(F.lit("no rows of label "), F.col("label"))).cast("long")).alias("n")
    return label_domain(df, labels).join(counts, "label", "left").select("label", n).crossJoin(total).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def class_pivot(df: DataFrame, by: str, label: str, labels: list[str]) -> DataFrame:
    return df.groupBy(by).pivot(label, labels).count().na.fill(0)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))


def group_stats(df: DataFrame, group: str) -> DataFrame:
    return group_sizes(df, group).agg(F.count("*").alias("groups"), F.count(F.when(F.col("size") > 1, 1)).alias("multi_row_groups"), F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("rows_in_multi"))


def crossing_groups(df: DataFrame, group: str, fold: str, nulls: bool = False) -> DataFrame:
    """Groups that stand in several folds; nulls: those of a null group are one group too."""
    df = df if nulls else df.where(F.col(group).isNotNull())
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table that the other lacks, with the side that has them."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def require_columns(df: DataFrame, columns: set[str]) -> None:
    if not columns <= set(df.columns):
        raise ValueError(f"missing columns: {sorted(columns - set(df.columns))}")


def require_none(violations: DataFrame, what: str) -> None:
    """Fail closed: raise if there is any violating row."""
    row = violations.first()
    if row is not None:
        raise ValueError(f"{what}: {row.asDict()}")


def checked_dataset(data: DataFrame, folds: DataFrame, labels: list[str], n_folds: int = 5) -> DataFrame:
    """data (row_id, text, label, group) joined 1:1 with folds (row_id, fold), after every contract."""
    require_columns(data, {"row_id", "text", "label", "group"})
    require_columns(folds, {"row_id", "fold"})
    require_none(repeated_keys(data, "row_id"), "row ids repeat in data")
    require_none(repeated_keys(folds, "row_id"), "row ids repeat in folds")
    require_none(key_differences(data, folds, "row_id"), "row ids differ")
    found = {r["fold"] for r in folds.select(F.col("fold").cast("int")).distinct().limit(n_folds + 1).collect()}
    if found != set(range(n_folds)):
        raise ValueError(f"folds are {sorted(found, key=str)}")
    seen = {r["label"] for r in data.select("label").distinct().limit(len(labels) + 1).collect()}
    if seen != set(labels):
        raise ValueError(f"labels are {sorted(seen, key=str)}")
    merged = data.join(folds.select("row_id", "fold"), "row_id")
    require_none(crossing_groups(merged, "group", "fold", nulls=True), "a group crosses folds")
    return merged


def canonical_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group, all columns: a minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first")).select("_first.*").select(df.columns)


def _digested(batches):
    """SHA-256 of the lines of all batches, joined by newlines, and their number."""
    digest, n = hashlib.sha256(), 0
    for batch in batches:
        for line in batch.column(0).to_pylist():
            digest.update(line.encode() if not n else b"\n" + line.encode())
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], ["row_order_sha256", "rows"])


def row_set_hash(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 of the ids in order, a line each.

    Range partitions are sorted each by itself, and one task takes their lines in turn, since a digest is
    a chain: it holds a batch of ids at a time.  row_set_tree digests in parallel.
    """
    ordered = df.where(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key)
    told = ordered.select(F.col(key).cast("string")).coalesce(1).mapInArrow(_digested, "row_order_sha256 string, rows long")
    return told.agg(F.coalesce(F.max("row_order_sha256"), F.sha2(F.lit(""), 256)).alias("row_order_sha256"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))  # no ids, no task


def row_set_tree(df: DataFrame, key: str, leaf: int = 4096) -> DataFrame:
    """(root_sha256, leaves, rows): the ids in order are digested in leaves of so many, in parallel, then the leaves' digests, a line each, in a digest of their own.

    A level more is made while there are more than `leaf` digests, so no row holds more than `leaf` of them.
    """
    level = with_rank(df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")), [], ["_k"], "_n").select((F.col("_n") - 1).alias("n"), F.col("_k").cast("string").alias("line"))
    n = level.count()
    leaves = first = -(-n // leaf)
    while True:
        level = level.groupBy(F.floor(F.col("n") / leaf).alias("n")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n"), 256).alias("line"))
        if leaves <= 1:
            return level.agg(F.coalesce(F.max("line"), F.sha2(F.lit(""), 256)).alias("root_sha256"), F.lit(first).cast("long").alias("leaves"), F.lit(n).cast("long").alias("rows"))
        leaves = -(-leaves // leaf)
