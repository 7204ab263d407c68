"""The text classifier end to end, and the serving contract."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import PERTURBATIONS
from tessera.operators import classifier, near, review, serving
from tessera.sources import files

NAMES = {"fruit": "apple pear plum cherry grape".split(), "tool": "hammer saw drill wrench pliers".split(), "bird": "robin crow finch heron swift".split()}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(150):
        label = sorted(NAMES)[i % 3]
        data.append((i, " ".join(rng.choice(NAMES[label]) if rng.random() < 0.8 else rng.choice(("the", "and", "of")) for _ in range(8)), label, i // 3 % 5))
    return spark.createDataFrame([*data, (150, "zzz qqq", "tool", 1), (151, None, "bird", 2)], "row_id long, text string, label string, fold int").cache()


@pytest.fixture(scope="module")
def domain(spark):
    return spark.createDataFrame([(x, i) for i, x in enumerate(sorted(NAMES))], "label string, idx int")


@pytest.mark.parametrize(("model_id", "folds"), [("multinomial_nb", (1, 2, 3, 4)), ("logistic_regression_c1_balanced", (1,)), ("linear_svm_c0_5", (2,)), ("random_forest", (3,))])
def test_folds_are_evaluated_without_a_leak(rows, domain, model_id, folds):
    pooled, records = classifier.evaluate_candidate(rows, domain, model_id, "row_id", "text", "label", folds=folds, representation="word")
    got = pooled.collect()
    assert sorted(r["row_id"] for r in got) == sorted(r["row_id"] for r in rows.where(F.col("fold").isin(*folds)).collect())
    assert all(r["fold"] == (1 if r["row_id"] == 150 else 2 if r["row_id"] == 151 else r["row_id"] // 3 % 5) for r in got)
    assert [r["fold"] for r in records] == list(folds) and all(r["macro_f1"] > 0.9 and r["features"] > 10 and r["train_seconds"] > 0 for r in records)
    assert all(0 <= r["confidence"] <= 1 for r in got)


def test_oversampled_folds(rows, domain):
    few = rows.where("label <> 'bird' OR row_id % 2 = 0")
    pooled, _ = classifier.evaluate_candidate(few, domain, "multinomial_nb", "row_id", "text", "label", folds=(1,), oversampled=True, representation="word")
    assert pooled.count() == few.where("fold = 1").count()


def test_saved_classifier_answers_alike_and_a_changed_file_is_refused(spark, rows, domain, tmp_path):
    fitted = classifier.TextClassifier("logistic_regression_c1", "combined", "p1", 50, 80).fit(rows.where("fold <> 0"), "row_id", "text", "label")
    assert fitted.labels == sorted(NAMES) and fitted.n_features <= 130
    test = rows.where("fold = 0").select("row_id", "text")
    before = {tuple(r) for r in fitted.predict(test, "row_id", "text").collect()}
    path = str(tmp_path / "kept")
    manifest = fitted.save(path, spark)
    assert manifest["labels"] == sorted(NAMES)
    assert {tuple(r) for r in classifier.load_classifier(spark, path, sorted(NAMES)).predict(test, "row_id", "text").collect()} == before
    with pytest.raises(ValueError, match="classes"):
        classifier.load_classifier(spark, path, ["fruit", "tool"])
    part = next((tmp_path / "kept" / "vocabulary" / "word").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    part.with_name(f".{part.name}.crc").unlink()  # the file system's own check
    with pytest.raises(ValueError, match="not the one"):
        classifier.load_classifier(spark, path)
    grid = {r["condition"]: r for r in classifier.robustness(fitted, rows.where("fold = 0"), domain, PERTURBATIONS, "row_id", "text", "label").collect()}
    assert set(grid) == set(PERTURBATIONS) and grid["clean"]["retention"] == 1 and grid["leetspeak"]["macro_f1"] <= grid["clean"]["macro_f1"]
    binary = classifier.transfer(fitted, rows.where("fold = 0"), "row_id", "text", F.col("label") != "fruit", "fruit").first()
    assert binary["tp"] + binary["fn"] == rows.where("fold = 0 AND label <> 'fruit'").count() and binary["accuracy"] > 0.9


def test_answers(spark):
    registry = spark.createDataFrame([("lr", "Logistic", "probability"), ("svm", "Linear", "softmax")], "id string, name string, confidence_kind string")
    asked = [("some text", "lr", 0.9), ("some text", None, 0.2), ("some text", "svm", 0.9), ("some text", "other", 0.9), (" \n ", "other", 0.9), ("", "lr", 0.9), (None, "lr", 0.9), ("x" * 500, "lr", 0.45), ("x" * 501, "lr", 0.9)]
    df = spark.createDataFrame(asked, "text string, model string, c double")
    got = [tuple(r[c] for c in ("status", "model_name", "confidence_kind", "category", "confidence", "needs_human_review", "message")) for r in serving.answers(df, registry, "lr", F.lit("tool"), F.col("c"), 0.45).orderBy(F.expr("1")).collect()]
    none = (None,) * 6
    want = [(200, "Logistic", "probability", "tool", 0.9, False, review.SUGGESTION), (200, "Logistic", "probability", "tool", 0.2, True, review.LOW), (200, "Linear", "softmax", "tool", 0.9, True, review.COMPARISON), (404, *none), (200, "Invalid input", "none", "invalid", 0.0, True, review.ASK_TEXT), (422, *none), (422, *none), (200, "Logistic", "probability", "tool", 0.45, False, review.SUGGESTION), (422, *none)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    serving.require_fields(df.select("text", "model"))
    with pytest.raises(ValueError, match="not a request"):
        serving.require_fields(df)
    assert tuple(serving.health(registry).first()) == (True, "2 selectable models")
    history = spark.createDataFrame([("a", "first_access", False), ("b", "reproduction", True)], "evaluated_at_utc string, kind string, selection_used_final_test boolean")
    assert [serving.final_test_protected(h).first()[0] for h in (history, history.where("NOT selection_used_final_test"), history.limit(0))] == [False, True, True]


def test_reproduction_fails_closed(spark):
    prior = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "metric string, value double")
    review.require_reproduced(prior, prior)
    for other in ([("a", 0.5)], [("a", 0.5), ("b", 0.250002)], [("a", 0.5), ("b", 0.25), ("c", 1.0)]):
        with pytest.raises(ValueError, match="not reproduced"):
            review.require_reproduced(spark.createDataFrame(other, "metric string, value double"), prior)


def test_a_long_chain_is_one_group(spark):
    text = "".join(chr(97 + (i * i + 3 * i) % 26) + chr(97 + i % 23) for i in range(40))
    chain = [(i, "".join(chr(65 + j % 26) if j < i else c for j, c in enumerate(text * 3))) for i in range(90)]
    got = near.near_groups(spark.createDataFrame([*chain, (900, None), (901, chain[4][1])], "id long, text string"), "id", "text", similarity=0.8)
    groups = {r["id"]: r["near_duplicate_group_id"] for r in got.collect()}
    assert {groups[i] for i in range(90)} == {0} and groups[900] == 900 and groups[901] == 0


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"), "a int")
    files.write_json(tmp_path / "x.json", {"b": 1, "a": "ä"})
    assert files.read_json(tmp_path / "x.json") == {"a": "ä", "b": 1}
    with pytest.raises(ValueError):
        files.write_json(tmp_path / "y.json", {"a": float("nan")})
    import hashlib

    data = (tmp_path / "x.json").read_bytes()
    files.require_hash(spark, str(tmp_path / "x.json"), hashlib.sha256(data).hexdigest())
    with pytest.raises(ValueError):
        files.require_hash(spark, str(tmp_path / "x.json"), "0" * 64)
    (tmp_path / "skipped").mkdir()
    (tmp_path / "skipped" / "z.csv").write_text("a")
    assert {r["suffix"]: r["files"] for r in files.file_counts(spark, str(tmp_path), ("skipped",)).collect()} == {".json": 1}
    manifest = {"rows": 2, "dimension": 3}
    made = lambda: spark.createDataFrame([(1, [0.0, 0.1, 0.2]), (2, [1.0, 0.0, 0.0])], "id long, embedding array<double>")
    for _ in range(2):
        assert files.cached_embeddings(spark, str(tmp_path / "emb"), manifest, made).count() == 2
    with pytest.raises(ValueError):
        files.cached_embeddings(spark, str(tmp_path / "emb"), {**manifest, "rows": 3}, made)
    assert files.provenance(spark)["spark"] == spark.version
