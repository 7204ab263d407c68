"""Every query with SQL gives the rows that the SQL gives, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tessera.plans import all_queries, all_sql

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(float(v)) if hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_against_sql(spark, duck, name):
    df = all_queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.execute(all_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_near_groups_hold_equal_texts(spark):
    from tessera.operators.near import near_groups

    df = spark.createDataFrame([(1, "a short sentence of words"), (2, "a short sentence of words"), (3, "something else altogether, no doubt"), (4, None)], "id long, text string")
    assert {r[0]: r[1] for r in near_groups(df, "id", "text").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_streamed_answers_equal_batch(spark):
    q = all_queries()
    batch, stream = q["predict_batch"](spark, DIR), q["predict_stream_batch"](spark, DIR)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


@pytest.mark.parametrize("name", ["lr_cv", "svm_cv", "nb_cv", "embedding_cv"])
def test_models_are_validated_on_all_development_rows(spark, name):
    from tessera.operators import folds
    from tessera.plans.catalog import rows
    from tessera.plans.models import SETTINGS, Fits
    from pyspark.sql import functions as F

    told = {r["part"]: r["rows"] for r in all_queries()[name](spark, DIR).collect()}
    if name == "embedding_cv":
        df = spark.read.parquet(f"{DIR}/embeddings.parquet").withColumn("fold", folds.group_fold(F.col("vec_id")))
    else:
        df = rows(spark, DIR)
    sizes = {str(r["fold"]): r["count"] for r in df.where("fold <> 0").groupBy("fold").count().collect()}
    assert sorted(sizes) == ["1", "2", "3", "4"]
    assert told == sizes | dict.fromkeys(("pooled", "mean", "deviation"), sum(sizes.values()))
    if name != "embedding_cv":
        fits = Fits(spark, DIR)
        assert SETTINGS["cap"] == 60_000 and set(fits.features.blocks) == {"word", "character"}


def test_a_part_of_the_store_is_made_once_and_again_after_a_break(spark, tmp_path):
    from tessera.operators.store import Store

    store, made = Store(spark, "x"), []
    store.root = str(tmp_path)
    make = lambda: made.append(1) or {"n": len(made)}
    assert store.once("part", {"a": (1, 2)}, make)["made"] == store.once("part", {"a": (1, 2)}, make)["made"] == {"n": 1}
    assert store.once("part", {"a": (1, 3)}, make)["made"] == {"n": 2}

    def breaks():
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        store.once("part", {"a": 4}, breaks)
    assert store.manifest("part") is None
