"""Boosted trees against a plain version that tries every split."""

import random

import numpy as np
import pytest

from tessera.operators import boosting, crossval

FEATURES, CLASSES, FOLDS = 9, 3, (1, 2, 3)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    rows = []
    for i in range(180):
        label = rng.choice((0, 0, 1, 2))
        held = sorted(j for j in range(FEATURES) if rng.random() < (0.7 if j % CLASSES == label else 0.25))
        rows.append((i, i % 4, label, held, [rng.choice((0.1, 0.2, 0.35, 0.5, 0.8)) + 0.001 * j for j in held]))
    return rows + [(180, 1, 1, [], []), (181, 2, None, [0, 3], [0.2, 0.2]), (182, 3, 2, [8], [-0.4])]


def problems(spark, table, parts=3):
    rows = spark.createDataFrame(table, "doc long, fold int, label int, idx array<int>, val array<double>").repartition(parts)
    return crossval.Problems(rows, CLASSES, FOLDS, FEATURES)


def plain_bins(table, fold):
    """Bins of every row's columns, by the quantiles of the fold's training rows; None where a row has no value."""
    level = lambda x: int(np.floor(x * boosting.STEPS))
    cuts = {}
    for j in range(FEATURES):
        seen = sorted(level(dict(zip(r[3], r[4]))[j]) for r in table if r[1] not in (0, fold) and r[2] is not None and j in r[3])
        cuts[j] = [seen[-(-i * len(seen) // boosting.BINS) - 1] for i in range(1, boosting.BINS)]
    return [{j: sum(level(x) > c for c in cuts[j]) for j, x in zip(r[3], r[4])} for r in table]


def plain_trees(table, fold, rounds, depth, rate):
    bins, out = plain_bins(table, fold), []
    scores = np.zeros((len(table), CLASSES))
    trained = [i for i, r in enumerate(table) if r[1] not in (0, fold) and r[2] is not None]
    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(CLASSES):
            pair = [np.rint(np.array([p[i, c] - (r[2] == c), max(2 * p[i, c] * (1 - p[i, c]), 1e-6)]) * boosting.UNIT).astype(int) for i, r in enumerate(table)]
            worth = lambda s: (s[0] / boosting.UNIT) ** 2 / (s[1] / boosting.UNIT + 1)
            told = lambda rows: sum((pair[i] for i in rows), np.zeros(2, int))
            tree = {}

            def grow(node, rows, everyone, level):
                best = (boosting.LEAST_GAIN, None)
                whole = told(rows)
                for j in range(FEATURES) if level < depth else ():
                    for b in sorted({bins[i][j] for i in rows if j in bins[i]}):
                        for absent in (False, True):
                            left = told([i for i in rows if (bins[i][j] <= b if j in bins[i] else absent)])
                            if min(left[1], (whole - left)[1]) >= boosting.UNIT:
                                gain = worth(left) + worth(whole - left) - worth(whole)
                                if gain > best[0]:
                                    best = (gain, (j, b, absent))
                if best[1] is None:
                    value = -rate * (whole[0] / boosting.UNIT) / (whole[1] / boosting.UNIT + 1)
                    tree[node] = value
                    for i in everyone:
                        scores[i, c] += value
                    return
                j, b, absent = tree[node] = best[1]
                goes = lambda i: bins[i][j] <= b if j in bins[i] else absent
                for side, keep in ((1, True), (2, False)):
                    grow(2 * node + side, [i for i in rows if goes(i) == keep], [i for i in everyone if goes(i) == keep], level + 1)

            grow(0, trained, range(len(table)), 0)
            out.append(tree)
    return out, scores


def test_trees_and_predictions_are_those_of_a_plain_version(spark, table, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)  # scores are written twice
    data = problems(spark, table)
    m = boosting.fit_boosted(data, rounds=5, depth=3, rate=0.3, rows=1.0, columns=1.0)
    nodes = {(r, f, c, n): (feature, b, absent) if feature is not None else value for r, f, c, n, feature, b, absent, _, value in boosting.tree_rows(m)}
    got = {r["doc"]: r for r in boosting.predict_boosted(data, m).collect()}
    split = 0
    for f in FOLDS:
        trees, scores = plain_trees(table, f, 5, 3, 0.3)
        for k, tree in enumerate(trees):
            mine = {n: v for (r, fold, c, n), v in nodes.items() if (r, fold, c) == (k // CLASSES, f, k % CLASSES)}
            assert mine.keys() == tree.keys()
            for n, v in tree.items():
                assert mine[n] == (v if isinstance(v, tuple) else pytest.approx(v, abs=1e-12))
                split += isinstance(v, tuple)
        for i, row in enumerate(table):
            if row[1] == f:
                e = np.exp(scores[i] - scores[i].max())
                assert got[row[0]]["prediction"] == scores[i].argmax()
                assert got[row[0]]["confidence"] == pytest.approx(e.max() / e.sum())
    assert split > 60 and len(got) == sum(r[1] != 0 for r in table)
    data.close()


def test_draws_do_not_depend_on_how_rows_are_dealt(spark, table):
    fits = []
    for parts in (1, 6):
        data = problems(spark, table, parts)
        fits.append(boosting.fit_boosted(data, rounds=3, depth=3))
        data.close()
    assert boosting.tree_rows(fits[0]) == boosting.tree_rows(fits[1])
    used = [{n[4] for n in boosting.tree_rows(fits[0]) if (n[0], n[1], n[2]) == (0, 1, c) and n[4] is not None} for c in range(CLASSES)]
    assert all(len(u) < FEATURES for u in used) and used[0] != used[1]


def test_no_training_rows(spark):
    data = problems(spark, [(0, 0, 1, [0], [0.5]), (1, 1, None, [], []), (2, 2, None, [3], [0.1])], 1)
    m = boosting.fit_boosted(data, rounds=1, depth=2)
    assert not m.value.any() and (m.feature < 0).all()
    assert {r["doc"]: (r["prediction"], round(r["confidence"], 9)) for r in boosting.predict_boosted(data, m).collect()} == {1: (0, round(1 / 3, 9)), 2: (0, round(1 / 3, 9))}
    data.close()


def test_splits_of_absent_rows_and_ties():
    """Two columns split alike: the first wins; rows without a value go where they gain."""
    key = lambda f, b: f * boosting.BINS + b
    u = boosting.UNIT
    keys = np.array([-1, key(2, 4), key(5, 0)])
    sums = np.array([[0, 8 * u], [4 * u, 4 * u], [4 * u, 4 * u]])
    (place, gain, feature, b, absent_left, left, both), = boosting.split_gains(keys, sums, 7, 1.0, 1.0)
    assert (place, feature, b, absent_left, left, both) == (0, 2, 4, False, [4.0, 4.0], [0.0, 8.0])
    assert gain == pytest.approx(16 / 5 + 16 / 5)
    assert boosting.split_gains(keys, sums, 7, 1.0, 5.0)[0][2] == -1  # no child may be so small
