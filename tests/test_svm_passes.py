import random

from pyspark.sql import functions as F

from tessera.operators import crossval


def test_a_pass_of_the_svm_scores_rows_once(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, i % 3, i % 5, [draw.gauss(0, 1) + 2 * (j % 3 == i % 3) for j in range(12)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, number int, fold int, v array<double>").coalesce(2)
    data = crossval.Problems(crossval.dense_rows(df, "id", "v", "number", "fold", 12), 3, (1, 2), 12)
    scored, sums = [], crossval.Problems.sums
    monkeypatch.setattr(crossval.Problems, "sums", lambda self, loss, spec, *weights: scored.append(len(weights)) or sums(self, loss, spec, *weights))
    fitted = crossval.fit_squared_hinge(data, 0.5)
    assert set(scored) == {1} and fitted.passes == len(scored) <= 60
    right = crossval.predict(data, fitted).where(F.col("label") == F.col("prediction")).count()
    assert right > 100  # of the 120 rows of folds 1 and 2
    data.close()
