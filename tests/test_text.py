from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit, review
from tessera.sources.files import read_csv


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_profiles(spark):
    assert one(spark, "Hi  @user see http://x/@y and a@b.c", T.profile_p0) == "Hi <USER> see <URL> and a@b.c"
    assert one(spark, "É@x #Tag x#no www.X.com", T.profile_p1) == "é@x hashtag_tag x#no <url>"
    assert one(spark, "The #Tag of_it, @me!", T.profile_p2) == "tag"
    assert one(spark, None, T.profile_p1) == ""
    assert one(spark, "ﬁne　ＡＢ", T.normalize) == "fine AB"


def test_perturbations(spark):
    assert one(spark, "sooo!!! aa", T.normalize_repeats) == "so! aa"
    assert one(spark, "a\n\n\nb", T.normalize_repeats) == "a\n\n\nb"
    assert one(spark, "four fives sixsix", T.partial_masking) == "four fi**s si***x"
    assert one(spark, "Aeios", T.leetspeak) == "A3105"
    assert one(spark, "a-b", T.remove_punctuation) == "a b"


def test_char_ngrams(spark):
    assert one(spark, "ab c", T.char_wb_ngrams) == [" ab", "ab ", " ab ", " c "]


def test_csv_null_tokens(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n1,NA\n2,"a ""b"",\nc"\n3,\n4,nan\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), "id long, text string").orderBy("id").collect()] == [(1, None), (2, 'a "b",\nc'), (3, None), (4, None)]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1.0, True), (0.6, True), (0.5, False)], "c double, ok boolean")
    assert abs(review.calibration_error(df, "c", F.col("ok")).first()[0] - 0.5 / 3) < 1e-12


def test_contracts_fail_closed(spark):
    import pytest

    data = spark.createDataFrame([(i, "t", "ab"[i % 2], i) for i in range(10)], "row_id long, text string, label string, group long")
    folds = spark.createDataFrame([(i, i % 5) for i in range(10)], "row_id long, fold int")
    assert audit.checked_dataset(data, folds, ["a", "b"]).count() == 10
    for bad_data, bad_folds, labels in ((data, folds.where("fold < 4"), ["a", "b"]), (data.union(data), folds, ["a", "b"]), (data, folds, ["a"]), (data.withColumn("group", F.lit(1)), folds, ["a", "b"])):
        with pytest.raises(ValueError):
            audit.checked_dataset(bad_data, bad_folds, labels)
