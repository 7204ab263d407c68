"""Null columns, empty and long texts, repeated rows, empty tables and clashing column names, for operators that carry rows and for the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, quality_classifier, sharding
from tessera.llm.shared import materialize, shared_dir

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_key", "_gone", "_id", "_found", "_kept", "_crc", "_size", "_nth", "key", "text_", "shard_", "label", "bucket", "component_id")


def words(rng, n):
    return " ".join(rng.choice(("one", "word", "after", "another", "makes", "some", "plain", "text", "here")) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, 80), "en", "s", 1) for i in range(40)]
    rows += [rows[0], rows[1], (40, None, None, None, None), (41, "", "en", "s", 0), (42, " \n\t\n ", None, "s", 3), (None, words(rng, 60), "en", None, None), (43, words(rng, 60_000), "en", "s", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, name):
    """No stage fails on odd rows, changes a column that it does not own, or makes up rows; an empty table gives none."""
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, DIR)
    if name == "packing":
        ids = [r["doc_id"] for r in odd.select("doc_id").collect()]
        assert sorted(map(str, [r["doc_id"] for r in got.where("piece = 0").collect()])) == sorted(map(str, ids))
    else:
        assert got.columns == odd.columns
        assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHES)
        assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in odd.collect()}
        if name == "decontaminate":
            assert got.count() == odd.count()
        if name == "near_duplicates":
            assert got.where("doc_id IN (40, 41, 42) OR doc_id IS NULL").count() == 4
        if name == "quality_rules":
            assert got.where("doc_id IN (40, 41, 42)").count() == 0
    assert stage(spark, odd.limit(0), DIR).count() == 0


def test_lines_keep_clashing_columns(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_dropped"] and got.count() == odd.count()
    assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHES)


def test_shards_keep_clashing_columns(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == odd.count() and all(r[c] == f"own {c}" for r in got.collect() for c in CLASHES)


def test_classifier_takes_clashing_columns_and_repeated_labels(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(0, 1, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, _id string")
    assert quality_classifier.score_quality(odd, quality_classifier.fit_quality(odd, labels)).count() == odd.count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_pipeline_follows_its_stages(spark, odd):
    """Each stage's decisions, from a plain reading of the stages before."""
    docs = materialize(corpus_pipeline.quality_rules(spark, odd, DIR), "stage")
    texts = {r["text"] for r in docs.collect()}
    assert all(len(t.split()) >= 20 for t in texts)
    first = materialize(corpus_pipeline.near_duplicates(spark, docs, DIR), "stage")
    same = {}
    for r in docs.collect():
        same[r["text"]] = min(same.get(r["text"], 1 << 60), 1 << 60 if r["doc_id"] is None else r["doc_id"])
    assert {r["text"]: 1 << 60 if r["doc_id"] is None else r["doc_id"] for r in first.collect()} == same


def test_lines_with_a_count_of_their_own_in_other_case(spark, odd):
    docs = odd.withColumn("N_Dropped", F.lit("own"))
    got = corpus_pipeline.line_dedup(spark, docs, DIR)
    assert got.columns == docs.columns and {r["N_Dropped"] for r in got.collect()} == {"own"}
    assert line_dedup.dedup_lines(docs).columns == [*odd.columns, "n_dropped"]


def test_very_many_lines_of_one_text_go(spark):
    many = [f"this line recurs in every text as number {k} of them" for k in range(100_000)]
    own = [" ".join(["abcdef"[i] * 6] * (4 + i)) for i in range(6)]  # of another length each, so of no common template
    rows = [(i, "\n".join([own[i], *many, "", own[i] + " end"])) for i in range(6)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    for i in range(1, 6):
        assert got[i]["text"] == f"{own[i]}\n\n{own[i]} end" and got[i]["n_dropped"] == 100_000
