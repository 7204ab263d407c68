"""Fold assignment: by group, stratified, and balanced by class over whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import with_rank
from tessera.operators.tables import materialize

#: Kinds of groups (equal counts of every class) that are balanced together on the driver, the largest first.
MOST_KINDS = 100_000


def shared_hash(c: Column, salt: str = "") -> Column:
    """The first 32 bits of an md5, as a long: any engine has it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def group_fold(group: Column, folds: int = 5) -> Column:
    """All rows of a group in one fold."""
    return (shared_hash(group) % folds).cast("int")


def _shuffled(df: DataFrame, label: str, key: str, salt: str) -> DataFrame:
    """df with _nth: the place of a row among its label's, by a hash of its key, from 0."""
    ranked = with_rank(df.withColumn("_h", shared_hash(F.col(key), salt)), [label], ["_h", key], "_nth")
    return ranked.withColumn("_nth", F.col("_nth") - 1).drop("_h")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 4, salt: str = "42") -> DataFrame:
    """Folds 1 to folds; per label their sizes differ by one at most."""
    return _shuffled(df, label, key, salt).withColumn("random_fold", (F.pmod("_nth", F.lit(folds)) + 1).cast("int")).drop("_nth")


def _dealt(kinds: list[tuple[list[int], int]], totals: list[int], folds: int) -> list[list[int]]:
    """Of each kind (counts of its classes, groups) the folds of the groups that do not come out even.

    A kind's groups are dealt evenly; each of the at most folds - 1 that are left goes to the fold that
    lacks most of its classes, each class weighed by its rarity, the first of equals. Whole numbers only.
    """
    weight = [10**9 // max(t, 1) for t in totals]
    have = [[0] * len(totals) for _ in range(folds)]
    out = []
    for counts, groups in kinds:
        left, used = groups % folds, []
        for _ in range(left):
            over = [sum(h[c] for h in have) for c in range(len(totals))]
            lacks = [sum(n * (over[c] - folds * have[f][c]) * weight[c] for c, n in enumerate(counts)) if f not in used else None for f in range(folds)]
            best = max((f for f in range(folds) if f not in used), key=lambda f: (lacks[f], -f))
            used.append(best)
            have[best] = [h + n for h, n in zip(have[best], counts, strict=True)]
        out.append(used)
    return out


def balanced_group_folds(df: DataFrame, group: str, label: str, labels: list[str], folds: int = 4, salt: str = "42") -> DataFrame:
    """(group, balanced_fold) with folds 1 to folds: no group crosses, and every fold has nearly the same share of each class.

    Groups that hold the same number of each class are of a kind, and interchangeable.  A kind's groups are
    dealt evenly by rank; what does not come out even is placed by class deficit, kinds of large groups first.  Only kinds
    are gathered, MOST_KINDS at most: the groups of smaller ones beyond are dealt by rank alone, so that each
    of those adds one group to a fold at most.  Two folds' counts of a class differ by no more than the
    counts of that class in the largest group, while kinds are within the bound and small groups fill up what large ones leave.  Rows with
    a null group, or a label out of the domain, count for none.
    """
    known = df.where(F.col(group).isNotNull() & F.col(label).isin(labels))
    counts = known.groupBy(group, label).agg(F.count("*").alias("_n"))
    per_group = counts.groupBy(group).agg(F.array(*[F.coalesce(F.sum(F.when(F.col(label) == x, F.col("_n"))), F.lit(0)) for x in labels]).alias("_kind"))
    kinds = per_group.groupBy("_kind").agg(F.count("*").alias("_groups"))
    size = F.aggregate("_kind", F.lit(0).cast("long"), lambda a, x: a + x)
    first = kinds.orderBy(size.desc(), F.col("_kind").desc()).limit(MOST_KINDS).collect()
    totals = [r["n"] for r in kinds.select(F.posexplode(F.transform("_kind", lambda x: x * F.col("_groups"))).alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).orderBy("c").collect()]  # a row a class
    if not first:
        return per_group.select(group, F.lit(1).alias("balanced_fold"))
    extra = _dealt([(r["_kind"], r["_groups"]) for r in first], totals, folds)
    told = df.sparkSession.createDataFrame([(r["_kind"], r["_groups"] // folds * folds, e) for r, e in zip(first, extra, strict=True)], "_of array<long>, _even long, _extra array<int>")
    ranked = _shuffled(per_group, "_kind", group, salt)
    placed = ranked.join(told, F.col("_kind") == F.col("_of"), "left")
    dealt = F.when(F.col("_nth") < F.coalesce("_even", F.col("_nth") + 1), F.pmod("_nth", F.lit(folds)).cast("int")).otherwise(F.get("_extra", (F.col("_nth") - F.col("_even")).cast("int")))
    return placed.select(group, (dealt + 1).cast("int").alias("balanced_fold"))


def with_random_fold(df: DataFrame, label: str, key: str, fold: str = "fold") -> DataFrame:
    """Development rows get a stratified fold, protected rows (fold 0) keep 0."""
    own = materialize(df.where(~F.col(fold).eqNullSafe(F.lit(0))).select(key, label), "development")  # no text is ranked, and what folds are made of is worked out once
    made = stratified_folds(own, label, key).select(key, "random_fold")
    return df.join(made, key, "left").withColumn("random_fold", F.coalesce("random_fold", F.lit(0)))


def split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation): protected rows in neither; either empty raises."""
    train = df.where(~F.col(fold_col).eqNullSafe(F.lit(fold)) & ~F.col("fold").eqNullSafe(F.lit(0)))
    valid = df.where(F.col(fold_col).eqNullSafe(F.lit(fold)))
    if train.isEmpty() or valid.isEmpty():
        raise ValueError(f"fold {fold} leaves no training or no validation rows")
    return train, valid


def oversample(df: DataFrame, label: str, key: str, salt: str = "42") -> DataFrame:
    """Each class to the size of the largest: the smaller ones with replacement, by hashed draws."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    draws = df.sparkSession.range(most).withColumnRenamed("id", "_draw").crossJoin(F.broadcast(sizes))  # a row a class
    own = F.pmod(shared_hash(F.concat_ws(":", F.col(label), "_draw"), salt), F.col("_n"))
    drawn = draws.select(label, F.when(F.col("_n") == most, F.col("_draw")).otherwise(own).alias("_nth"))
    return _shuffled(df, label, key, salt).join(drawn, [label, "_nth"]).drop("_nth")
