"""Batched cross-validation, ranks, folds, quantiles, near duplicates and requests against plain versions."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, crossval, folds, metrics, near, ranks, serving
from tessera.operators.ranks import with_rank

WORDS = {0: "red green blue colour paint shade", 1: "one two three number count sum", 2: "dog cat bird horse fish tail"}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        label = rng.choice((0, 0, 0, 1, 1, 2))
        own = WORDS[label].split() + WORDS[rng.randrange(3)].split()
        rows.append((i, " ".join(rng.choice(own) for _ in range(rng.randrange(1, 9))), label, i % 5))
    rows += [(150, "", 0, 1), (151, "zzz qqq", 1, 2), (152, None, 2, 3)]
    return spark.createDataFrame(rows, "id long, text string, number int, fold int")


@pytest.fixture(scope="module")
def problems(texts):
    made, rows = crossval.fit_features(texts, "id", "text", "number", "fold", lambda c: F.coalesce(F.lower(c), F.lit("")), folds=(1, 2, 3, 4, 0))
    data = crossval.Problems(rows, 3, (1, 2, 3, 4, 0), made.idf.shape[1], made.idf, tuple(made.starts))
    yield made, data
    data.close()


def plain_terms(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if len(w) > 1]
    found = [("word", w) for w in words] + [("word", f"{a} {b}") for a, b in zip(words, words[1:])]
    for w in (text or "").lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            found += [("character", w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [("character", w)] if n == 3 else []
    return Counter(found)


def plain_matrix(rows, fold):
    """(train, valid) matrices of the fold, its vocabulary from its training rows."""
    train = [r for r in rows if r["fold"] not in (fold, 0)]
    df, n = Counter(t for r in train for t in plain_terms(r["text"])), len(train)
    terms = sorted(t for t, c in df.items() if 2 <= c <= 0.95 * n)
    at, idf = {t: k for k, t in enumerate(terms)}, np.array([np.log((1 + n) / (1 + df[t])) + 1 for t in terms])
    word = np.array([b == "word" for b, _ in terms])

    def matrix(part):
        x = np.zeros((len(part), len(terms)))
        for k, r in enumerate(part):
            for t, c in plain_terms(r["text"]).items():
                if t in at:
                    x[k, at[t]] = (1 + np.log(c)) * idf[at[t]]
            for block in (word, ~word):
                x[k, block] /= np.linalg.norm(x[k, block]) or 1
        return x

    valid = [r for r in rows if r["fold"] == fold]
    return train, matrix(train), valid, matrix(valid)


def test_vocabularies_are_those_of_the_training_rows(texts, problems):
    made, data = problems
    rows = texts.collect()
    for k, fold in enumerate(made.folds):
        train, x, _, _ = plain_matrix(rows, fold)
        assert made.sizes()[fold] == x.shape[1]
        fitted = crossval.fit_naive_bayes(data)
        y = np.array([r["number"] for r in train])
        sums = np.stack([x[y == c].sum(0) for c in range(3)]) + 1
        want = np.log(sums) - np.log(sums.sum(1, keepdims=True))
        got = fitted.weights[3 * k : 3 * k + 3][:, made.idf[k] > 0]
        assert np.abs(np.sort(got, 1) - np.sort(want, 1)).max() < 1e-9


def test_logistic_regression_reaches_the_optimum(texts, problems):
    made, data = problems
    fitted = crossval.fit_logistic(data, 1.0, balanced=True, tolerance=1e-7)
    rows = texts.collect()
    predicted = {r["doc"]: (r["prediction"], r["confidence"]) for r in crossval.predict(data, fitted).collect()}
    assert len(predicted) == len(rows)
    for k, fold in enumerate(made.folds):
        train, x, valid, xv = plain_matrix(rows, fold)
        y = np.array([r["number"] for r in train])
        weight = len(y) / (3 * np.bincount(y, minlength=3))[y]
        w, b, hot = np.zeros((3, x.shape[1])), np.zeros(3), np.eye(3)[y]
        for _ in range(6000):  # plain gradient descent
            p = np.exp(x @ w.T + b)
            p /= p.sum(1, keepdims=True)
            r = weight[:, None] * (p - hot) / weight.sum()
            w, b = w - 1.5 * (r.T @ x + w / weight.sum()), b - 1.5 * r.sum(0)
        p = np.exp(x @ w.T + b)
        p /= p.sum(1, keepdims=True)
        loss = -(weight * np.log(p[np.arange(len(y)), y])).sum() / weight.sum() + (w * w).sum() / 2 / weight.sum()
        assert abs(fitted.loss[k] - loss) < 1e-5
        s = np.exp(xv @ w.T + b)
        s /= s.sum(1, keepdims=True)
        for r, q in zip(valid, s, strict=True):
            assert abs(predicted[r["id"]][1] - q.max()) < 1e-2
            assert predicted[r["id"]][0] == q.argmax() or q.max() - np.sort(q)[-2] < 1e-2


def test_svm_reaches_the_loss_of_an_exact_solve(texts, problems):
    made, data = problems
    fitted = crossval.fit_squared_hinge(data, 0.5, tolerance=1e-8)
    rows = texts.collect()
    for k, fold in enumerate(made.folds[:2]):
        train, x, _, _ = plain_matrix(rows, fold)
        x = np.append(x, np.ones((len(x), 1)), 1)
        for c in range(3):
            y = np.where([r["number"] == c for r in train], 1.0, -1.0)
            w = np.zeros(x.shape[1])
            for _ in range(50):  # Newton with the whole Hessian
                short = np.maximum(0, 1 - y * (x @ w))
                g = w - x.T @ (y * short)
                active = x[short > 0]
                w = w - np.linalg.solve(np.eye(len(w)) + active.T @ active, g)
            loss = w @ w / 2 + 0.5 * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
            assert abs(fitted.loss[3 * k + c] - loss) < 1e-6 * max(1, loss)


def test_ranks_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("hot", "hot", "hot", "a", None)), rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "label string, x int, id int").repartition(7)
    got = {r["id"]: r["rank"] for r in with_rank(df, ["label"], ["x", "id"]).collect()}
    for label in ("hot", "a", None):
        for k, (_, i) in enumerate(sorted((x, i) for y, x, i in rows if y == label)):
            assert got[i] == k + 1
    assert sorted(r["rank"] for r in with_rank(df, [], ["id"]).collect()) == list(range(1, 3001))
    assert with_rank(df.limit(0), ["label"], ["x"]).count() == 0


def test_balanced_folds_keep_groups_and_shares(spark):
    rng = random.Random(12)
    rows = []
    for g in range(900):
        size = rng.choice((1, 1, 1, 2, 3, 5, 9))
        main = rng.choice("aaabbc")
        rows += [(f"g{g}", main if rng.random() < 0.8 else rng.choice("abc")) for _ in range(size)]
    rows += [("big", "a")] * 40 + [(None, "a"), ("odd", None)]
    df = spark.createDataFrame(rows, "grp string, label string")
    out = {r["grp"]: r["balanced_fold"] for r in folds.balanced_group_folds(df, "grp", "label", ["a", "b", "c"]).collect()}
    known = [(g, y) for g, y in rows if g and y]
    assert set(out) == {g for g, _ in known} and set(out.values()) == {1, 2, 3, 4}
    per = Counter((out[g], y) for g, y in known)
    for y in "abc":
        counts = [per[f, y] for f in (1, 2, 3, 4)]
        largest = max(Counter(g for g, z in known if z == y).values())
        assert max(counts) - min(counts) <= largest
    assert folds.balanced_group_folds(df.limit(0), "grp", "label", ["a"]).count() == 0


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FEW", 50)
    monkeypatch.setattr(metrics, "BINS", 16)
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=2000), np.repeat(0.25, 500), np.concatenate((np.repeat(1.0, 900), rng.random(700) * 1e-9, [1e12, -1e12])), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        assert metrics.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.75, 1.0]) == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 0.75, 1]).tolist(), rel=1e-12, abs=1e-18)
    assert metrics.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_digests(spark):
    ids = random.Random(3).sample(range(10**6), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(6)
    lines = [str(i) for i in sorted(ids)]
    assert audit.row_set_hash(df, "id").first()[0] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    level = lines
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[k : k + 7]).encode()).hexdigest() for k in range(0, len(level), 7)]
    assert tuple(audit.row_set_tree(df, "id", leaf=7).first()) == (level[0], 72, 500)
    assert audit.row_set_hash(df.limit(0), "id").first()["rows"] == 0
    assert tuple(audit.row_set_tree(df.limit(0), "id").first()) == (hashlib.sha256(b"").hexdigest(), 0, 0)


def test_near_links_connect_what_pairs_connect(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(80)) for _ in range(6)]
    change = lambda t: "".join(c if rng.random() > 0.012 else rng.choice("xyz") for c in t)
    rows = [(k, change(rng.choice(base))) for k in range(160)] + [(1000, None), (1001, ""), (1002, "abc"), (1003, base[0]), (1004, base[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {i: {t[j : j + 5] for j in range(max(1, len(t) - 4))} for i, t in rows if t is not None}
    own = {i: i for i, _ in rows}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    bar, ids, links = Fraction(3, 5), sorted(sets), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= bar * len(sets[a] | sets[b]):
                links.add((a, b))
                own[max(root(a), root(b))] = min(root(a), root(b))
    got = {r[0]: r[1] for r in near.near_groups(df, "id", "text", similarity=0.6).collect()}
    assert got == {i: root(i) for i, _ in rows}
    texts = dict(rows)
    first = {}
    for i in ids:
        first.setdefault(texts[i], i)
    found = {(r["a"], r["b"]) for r in near.near_pairs(df, "id", "text", similarity=0.6).collect()}
    assert found == {(a, b) for a, b in links if first[texts[a]] == a and first[texts[b]] == b and texts[a] != texts[b]}
    assert near.near_links(df, "id", "text", similarity=0.6).count() <= len(found)


def test_requests_fail_closed(spark, tmp_path):
    long = "x" * 501
    bodies = ['{"text": "hi"}', '{"text": "hi", "model": "m"}', '{"text": "hi", "model": null}', '{"text": "hi", "more": 1}', '{"model": "m"}', '{"text": null}', '{"text": ["hi"]}', '{"text": "hi", "model": 4}', '{"text": ""}', f'{{"text": "{long}"}}', "{", "", None, "[]", '"hi"', "3"]
    want = [None, None, None, "extra_field", "no_text", "no_text", "text_not_a_string", "model_not_a_string", "text_length", "text_length", "not_json", "not_json", "not_json", "not_an_object", "not_an_object", "not_an_object"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    parsed = serving.parse_requests(df, "body")
    assert [r["reason"] for r in parsed.orderBy("id").collect()] == want
    good, bad = serving.split_requests(parsed)
    assert good.count() == 3 and bad.count() == len(bodies) - 3 and {r["text"] for r in good.collect()} == {"hi"}
    df.write.parquet(str(tmp_path / "bodies"))  # a stream takes the same plan
    stream = spark.readStream.schema("id int, body string").parquet(str(tmp_path / "bodies"))
    run = serving.parse_requests(stream, "body").writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["reason"] for r in spark.table("parsed").orderBy("id").collect()] == want


def test_a_pass_sends_one_gradient_a_core(spark, texts, monkeypatch):
    df = texts.repartition(40)
    made, rows = crossval.fit_features(df, "id", "text", "number", "fold", lambda c: F.coalesce(F.lower(c), F.lit("")))
    monkeypatch.setattr(crossval, "ENTRIES", 64)
    data = crossval.Problems(rows.repartition(40), 3, (1, 2, 3, 4), made.idf.shape[1], made.idf, tuple(made.starts))
    assert data.blocks().columns == ["fold", "label", "idx", "val", "order", "sizes", "scale"]
    spec = data.problem_spec([0, 1, 2, 3], np.ones((4, 3)))
    rng = np.random.default_rng(5)
    w, b = rng.normal(size=(12, spec.features)), rng.normal(size=12)
    loss, gb, gw = data.sums("logistic", spec, (w, b))
    step = 1e-5 * rng.normal(size=w.shape)
    moved = data.sums("logistic", spec, (w + step, b))[0]
    for p in range(4):
        own = slice(3 * p, 3 * p + 3)
        assert abs(moved[3 * p] - loss[3 * p] - (gw[own] * step[own]).sum()) < 1e-3 * abs(moved[3 * p] - loss[3 * p]) + 1e-7
    sent = data.spark.sparkContext.defaultParallelism
    assert data.blocks().coalesce(sent).rdd.getNumPartitions() <= sent
    data.close()


@pytest.mark.parametrize("shares", [(0.9, 0.5, 0.3, 0.02, 0.01), (0.001,) * 5, (1.0,) * 5])
def test_a_block_multiplies_as_the_plain_matrix(shares):
    """Common features as a matrix, rare ones in layers: both products are those of the rows; a row without entries too."""
    rng = np.random.default_rng(4)
    n, each, starts, folds_ = 300, 40, (0, 90), (1, 2)
    x = np.concatenate([rng.random((n, each)) * (rng.random((n, each)) < share) for share in shares], 1)
    x[17] = 0
    spec = crossval.Spec(folds_, 3, x.shape[1], starts, (0, 1), np.ones((2, 3)))
    scale = rng.random((n, len(folds_), len(starts)))
    place = [np.flatnonzero(r) for r in x]
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 3, n), pa.int32()), pa.array(rng.integers(-1, 3, n), pa.int32()), pa.array(place, pa.list_(pa.int32())), pa.array([r[p] for r, p in zip(x, place)], pa.list_(pa.float64())), pa.array(list(scale.reshape(n, -1)))], ["fold", "label", "idx", "val", "scale"])
    (told,) = [b for t in crossval._blocks(spec)([batch]) for b in t.to_pylist()]
    block, w, r = crossval._Block(told, spec), rng.normal(size=(x.shape[1], 6)), rng.normal(size=(n, 6))
    times, total = np.zeros((n, 6)), np.zeros_like(w)
    for c in range(6):
        scaled = x * np.repeat(scale[:, c // 3], [90, x.shape[1] - 90], 1)
        times[:, c], total[:, c] = scaled @ w[:, c] + c, scaled.T @ r[:, c]
    got = np.zeros_like(w)
    block.add(r, got)
    assert np.abs(block.times(w, np.arange(6.0)) - times).max() < 1e-9 and np.abs(got - total).max() < 1e-9
    assert len(block.layers) <= crossval.COMMON * n and len(block.common) == sum((x[:, k] != 0).sum() >= max(crossval.COMMON * n, 2) for k in range(x.shape[1]))


def test_near_pairs_move_texts_once_a_tile(spark, monkeypatch):
    """F11, F16: a family of near copies is compared in tiles of bounded size; each text travels once a tile and not once a pair."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij ") for _ in range(400))
    change = lambda t, k: "".join(c if rng.random() > k else rng.choice("xyz") for c in t)
    rows = [(k, change(base, 0.02)) for k in range(120)] + [(200 + k, change(base[: 40 + 7 * k], 0.01)) for k in range(50)] + [(300, None), (301, ""), (302, "abc"), (303, "abcde")]
    sets = {i: {t[j : j + 5] for j in range(max(1, len(t) - 4))} for i, t in rows if t is not None}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    monkeypatch.setattr(near, "TILE", 16)
    monkeypatch.setattr(near, "BLOCK_ROWS", 20)
    monkeypatch.setattr(near, "BLOCK_BYTES", 4096)
    found = near.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text", similarity=0.75).collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in found} == want and len(found) == len(want) > 1000
    moved = []
    held = near._similar
    monkeypatch.setattr(near, "_similar", lambda n, bar: lambda batches: (pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b.num_rows]), pa.array([1]), pa.array([1])], ["a", "b", "common", "union"]) for b in batches))
    moved = sum(r["b"] for r in near.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text", similarity=0.75).collect())
    monkeypatch.setattr(near, "_similar", held)
    assert moved < len(want)


def test_random_folds_rank_no_texts(spark, monkeypatch):
    """what is ranked holds the key and the label of a row, and not its text."""
    ranked = []
    held = ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda df, name, *by: ranked.append(df.columns) or held(df, name, *by))
    rows = [(k, f"text {k}", "ab"[k % 3 == 0], k % 5) for k in range(60)]
    got = folds.with_random_fold(spark.createDataFrame(rows, "id long, text string, label string, fold int"), "label", "id").collect()
    assert ranked and not any("text" in columns for columns in ranked)
    assert {r["id"]: (r["text"], r["fold"]) for r in got} == {k: (t, f) for k, t, _, f in rows}
    for label in "ab":
        dealt = Counter(r["random_fold"] for r in got if r["label"] == label and r["fold"])
        assert set(dealt) == {1, 2, 3, 4} and max(dealt.values()) - min(dealt.values()) <= 1
    assert all((r["random_fold"] == 0) == (r["fold"] == 0) for r in got)


def test_texts_are_cut_once(spark, texts):
    seen = spark.sparkContext.accumulator(0)

    def lowered(t):
        seen.add(1)
        return (t or "").lower()

    crossval.fit_features(texts, "id", "text", "number", "fold", F.udf(lowered).asNondeterministic())
    assert seen.value == texts.count()


def test_the_most_frequent_terms_of_each_fold(spark):
    rng = random.Random(9)
    rows = [(b, f"t{k:03}", f, rng.choice((2, 3, 3, 3, 7, k))) for b in ("word", "character") for f in (1, 2) for k in range(rng.randrange(90, 120))]
    for cap in (1, 40, 500):
        got = crossval._most_frequent(spark.createDataFrame(rows, "block string, term string, fold int, total long"), cap).collect()
        want = [r for b in ("word", "character") for f in (1, 2) for r in sorted((r for r in rows if r[0] == b and r[2] == f), key=lambda r: (-r[3], r[1]))[:cap]]
        assert sorted((r["block"], r["term"], r["fold"], r["total"]) for r in got) == sorted(want)


def test_logistic_regression_takes_few_passes_for_its_biases(problems, monkeypatch):
    _, data = problems
    few = crossval.fit_logistic(data, 1.0, balanced=True)
    monkeypatch.setattr(crossval, "BIAS", 1.0)
    many = crossval.fit_logistic(data, 1.0, balanced=True)
    assert few.passes < many.passes
    np.testing.assert_allclose(few.loss, many.loss, rtol=1e-3)


def test_rows_are_scaled_in_the_task_that_reads_them(problems):
    """Packed rows and predictions: one step in Python each, and a row is scored by its own fold's model alone."""
    _, data = problems
    fitted = crossval.fit_naive_bayes(data)
    for made in (data.blocks(), crossval.predict(data, fitted)):
        assert made._jdf.queryExecution().logical().toString().count("MapInArrow") == 1
    rng = np.random.default_rng(8)
    spec = data.problem_spec([0, 1, 2, 3, 4], np.ones((5, 3)))
    w, b = rng.normal(size=(15, spec.features)), rng.normal(size=15)
    batch = data.scaled.toArrow().combine_chunks().to_batches()[0]
    rows = crossval._Rows(batch, spec)
    which = rng.integers(0, 5, rows.n)
    np.testing.assert_allclose(rows.own(which, w, b), rows.times(w, b).reshape(rows.n, 5, 3)[np.arange(rows.n), which])
