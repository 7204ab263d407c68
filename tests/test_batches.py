import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import crossval, features

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _many(spark):
    spark.conf.set(ROWS, "10000")
    spark.conf.set(BYTES, str(1 << 30))
    return spark.range(0, 3000, 1, 1)


def test_terms_are_counted_in_small_batches(spark, monkeypatch):
    def sizes(blocks, folds=None):
        return lambda batches: (pa.RecordBatch.from_pydict({"block": ["word"], "term": [str(b.num_rows)], "df": [1], "total": [b.num_rows]}) for b in batches)

    monkeypatch.setattr(features.counting, "sums_by_term", sizes)
    monkeypatch.setattr(features, "spread", lambda df: df)
    df = _many(spark).select("id", F.lit("some words").alias("text"))
    got = features.term_sums(df, "id", F.col("text"), "word").collect()
    assert max(int(r["term"]) for r in got) <= 1000 and sum(r["total"] for r in got) == 3000


def test_packed_rows_are_read_in_small_batches(spark, monkeypatch):
    df = _many(spark).select("id", F.array(*[F.lit(0.5)] * 8).alias("v"), (F.col("id") % 2).alias("number"), (F.col("id") % 5).cast("int").alias("fold"))
    rows = crossval.dense_rows(df, "id", "v", "number", "fold", 8)
    monkeypatch.setattr(crossval, "ENTRIES", 9 * 700)
    data = crossval.Problems(rows, 2, (1, 2), 8)
    assert int(spark.conf.get(ROWS)) <= 1000 and int(spark.conf.get(BYTES)) <= 8 << 20
    sizes = [len(r["fold"]) // 4 for r in data.blocks().collect()]
    assert sizes == [700, 700, 700, 700, 200]  # blocks are as large as they may be, whatever the batches
    assert np.isclose(crossval.fit_naive_bayes(data).weights.sum(1), -8 * np.log(8)).all()
    data.close()


def test_packed_rows_are_read_few_at_once(spark):
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    data = crossval.Problems(crossval.dense_rows(_many(spark).select("id", F.array(F.lit(0.5)).alias("v"), (F.col("id") % 2).alias("number"), (F.col("id") % 5).cast("int").alias("fold")), "id", "v", "number", "fold", 1), 2, (1, 2), 1)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    data.close()
