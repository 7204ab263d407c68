"""Terms that are counted inside each row, against the tall table of all terms of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import features

ODD = ["", " ", "a", "a b", "ab ab\tab\ncd", "\x00x\x00 y\x00", "größe Straße 東京 東京 𝒜𝒷𝒸 naïve", "aa", "_", "x" * 3000, None]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = ["red", "green", "blue", "été", "x", "東京", "a_b", "42", "𝒜𝒷", "don't"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(200)] + [(200 + i, t) for i, t in enumerate(ODD * 2)]
    return rows + [(3, "red red été"), (3, None), (None, "green blue"), (None, "green 42")]  # keys that stand twice


def plain(df, block, cap):
    counts = features.analyzed_counts(df, "id", F.lower("text"), block)
    vocab = features.vocabulary(counts, df.count(), max_features=cap)
    return vocab, features.weigh(counts, vocab)


@pytest.mark.parametrize("block", ["word", "character"])
def test_terms_are_those_of_the_tall_table(spark, texts, block, monkeypatch):
    from tessera.operators import terms

    monkeypatch.setattr(terms, "SLICE", 50)
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    tall = features.TallTfidf(block, F.lower, 60, 60)
    got = {(r["doc"], r["term"]): r["value"] for r in tall.fit_transform(df, "id", "text").collect()}
    vocab, weighed = plain(df, block, 60)
    assert sorted(map(tuple, tall.vocabularies[block].collect())) == sorted(map(tuple, vocab.collect()))
    want = {(r["doc"], r["term"]): r["value"] for r in weighed.collect()}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


@pytest.mark.parametrize("block", ["word", "character"])
def test_no_row_of_a_document_is_shuffled(spark, texts, block):
    df = spark.createDataFrame([r for r in texts if r[0] is not None and r[0] != 3], "id long, text string").repartition(8)
    tall = features.TallTfidf(block, F.lower, 60, 60).fit(df, "id", "text")
    plan = tall.transform(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    sums = features.term_sums(df, "id", F.lower("text"), block)._jdf.queryExecution().executedPlan().toString()
    assert sums.count("hashpartitioning") == 1 and "hashpartitioning(term" in sums


def test_counts_inside_rows_are_those_of_the_tall_table(spark, texts):
    df = spark.createDataFrame([(k, t, "ab"[n % 2] if n % 7 else None) for n, (k, t) in enumerate(texts)], "id long, text string, label string").repartition(3)
    words = features.tokens(F.lower("text"))
    tall = features.term_counts(df, "id", words)
    assert sorted(map(str, features.document_counts(df, "id", words).collect())) == sorted(map(str, tall.collect()))
    want = tall.join(df.select(F.col("id").alias("doc"), "label"), "doc").groupBy("label", "term").agg(F.sum("tf").alias("n"))
    assert sorted(map(str, features.label_sums(df, "id", "label", words).collect())) == sorted(map(str, want.collect()))
    once = df.where("id > 3")
    assert "hashpartitioning" not in features.document_counts(once, "id", words)._jdf.queryExecution().executedPlan().toString()
    sums = features.label_sums(once, "id", "label", words)._jdf.queryExecution().executedPlan().toString()
    assert sums.count("hashpartitioning") == 1 and "hashpartitioning(label" in sums
