"""Models fitted together against plain Newton steps, and the nested choice against a loop over folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyplab.operators import logistic as R, select as G, selector as S


def plain(x, y, strength, balanced, columns):
    """Impute by medians, scale, and take Newton steps until nothing changes; returns the probability function."""
    with np.errstate(all="ignore"):
        med = np.array([np.nanmedian(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in x.T])
    full = np.where(np.isfinite(x), x, med)
    mean, dev = full.mean(0), full.std(0)
    dev = np.where(dev > 1e-10, dev, 1.0)
    z = lambda v: np.c_[np.ones(len(v)), ((np.where(np.isfinite(v), v, med) - mean) / dev)[:, list(columns)]]
    if len(set(y)) == 1:
        return lambda v: np.full(len(v), float(y[0]))
    a = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    zt, w = z(x), np.zeros(1 + len(columns))
    penalty = np.r_[0.0, np.full(len(columns), 1 / strength)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-zt @ w))
        w = w - np.linalg.solve(zt.T @ (zt * (a * p * (1 - p))[:, None]) + np.diag(penalty), zt.T @ (a * (p - y)) + penalty * w)
    return lambda v: 1 / (1 + np.exp(-z(v) @ w))


def some(n=300, d=4, gaps=True):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 3] + [0, 100, 5, 0]
    y = (x[:, 0] + 0.1 * (x[:, 1] - 100) + rng.normal(size=n) > 0.4).astype(float)
    if gaps:
        x[rng.random((n, d)) < 0.05] = np.nan
        x[3, 2] = np.inf
    return x, y, rng.integers(0, 6, n)


@pytest.mark.parametrize("fan", [32, 2])
def test_models_fitted_together_equal_plain_newton(spark, monkeypatch, fan):
    monkeypatch.setattr(R, "FAN", fan)
    x, y, cell = some()
    df = spark.createDataFrame([(v.tolist(), float(u), int(c)) for v, u, c in zip(x, y, cell)], "x array<double>, y double, cell long").repartition(9)
    sets = [[0, 1, 2], [1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5]]
    models = [R.Model(t, cols, c, b) for t in range(3) for cols in ((0, 1, 2, 3), (1, 3)) for c in (0.05, 5.0) for b in (False, True)]
    weights, scale = R.fit(df, "x", "y", "cell", sets, models, 4)
    for w, m in zip(weights, models):
        mine = np.isin(cell, sets[m.train])
        want = plain(x[mine], y[mine], m.strength, m.balanced, m.columns)(x)
        # medians come from a sketch: one of two middle values instead of their mean
        assert np.abs(R.probabilities(x, m.train, w[None], scale)[:, 0] - want).max() < 5e-3


def test_without_gaps_the_fit_is_the_same_to_six_digits(spark):
    x, y, cell = some(gaps=False)
    df = spark.createDataFrame([(v.tolist(), float(u), int(c)) for v, u, c in zip(x, y, cell)], "x array<double>, y double, cell long")
    weights, scale = R.fit(df, "x", "y", "cell", [[0, 2, 4]], [R.Model(0, (0, 1, 2, 3), 1.0, True)], 4)
    mine = cell % 2 == 0
    want = plain(x[mine], y[mine], 1.0, True, (0, 1, 2, 3))(x)
    assert np.abs(R.probabilities(x, 0, weights, scale)[:, 0] - want).max() < 1e-6


def test_separable_and_one_label_sets(spark):
    rows = [([float(i)], float(i >= 10), i % 2) for i in range(20)] + [([1.0], 1.0, 2)]
    df = spark.createDataFrame(rows, "x array<double>, y double, cell long")
    weights, scale = R.fit(df, "x", "y", "cell", [[0, 1], [2], [9]], [R.Model(t, (0,), 5.0, False) for t in range(3)], 1)
    x = np.array([[0.0], [19.0]])
    p = [R.probabilities(x, t, weights[[t]], scale)[:, 0] for t in range(3)]
    assert p[0][0] < 0.1 < 0.9 < p[0][1] and (p[1] > 0.999).all() and (p[2] < 0.001).all()


def table(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "it's", "gamma", "delta"]
    rows = []
    for i in range(160):
        a, b = ([words[k] for k in rng.integers(0, 5, rng.integers(1, 8))] for _ in range(2))
        lp = rng.normal(size=4)
        good = float(lp[0] - lp[1]) + rng.normal() * 0.5 > 0
        rows.append((f"s{i % 16}", 5, 30, *((0, 1, 3, 9) if good else (3, 9, 0, 1)), " ".join(a), " ".join(b), len(a), len(b), *rng.random(2).tolist(),
                     None if i % 11 == 0 else float(lp[0]), float(lp[1]), *lp[2:].tolist(), float(rng.random()), i % 16 % 3))
    return spark.createDataFrame(rows, "speaker_id string, nw long, nc long, a_we long, a_ce long, b_we long, b_ce long, a_hypothesis string, b_hypothesis string, "
        "a_words int, b_words int, a_oov_rate double, b_oov_rate double, a_unigram_logprob double, b_unigram_logprob double, "
        "a_char_trigram_logprob double, b_char_trigram_logprob double, pair_error double, fold int")


def test_nested_selector_equals_a_loop_over_folds(spark):
    df = table(spark)
    names = list(S.FEATURE_SETS["lm"])
    held = S.features(df).withColumn("inner", G.hash_fold(F.col("speaker_id"), "inner", 2)).toPandas()
    x, y = held[names].to_numpy(float), held["label"].to_numpy()
    fold, part = held["fold"].to_numpy(), held["inner"].to_numpy()
    configs = [(s, c, w) for s in S.FEATURE_SETS for c in (0.2, 5.0) for w in S.WEIGHTS]
    index = {s: [names.index(c) for c in S.FEATURE_SETS[s]] for s in S.FEATURE_SETS}

    def score(rows, first):
        we, ce = (np.where(first, held[f"a_{c}"][rows], held[f"b_{c}"][rows]).sum() for c in ("we", "ce"))
        return 0.5 * we / held["nw"][rows].sum() + 0.5 * ce / held["nc"][rows].sum()

    got = {r["fold"]: r for r in S.nested_selector(df, 3, 2, strengths=(0.2, 5.0)).collect()}
    assert sorted(got) == [0, 1, 2]
    for f in range(3):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        scores = {}
        for s, c, w in configs:
            p = np.zeros(len(y))
            for k in range(2):
                seen, new = train[part[train] != k], train[part[train] == k]
                p[new] = plain(x[seen], y[seen], c, w == "balanced", index[s])(x[new])
            for t in S.THRESHOLDS:
                scores[s, c, w, t] = score(train, p[train] >= t)
        r = got[f]
        mine = (r["feature_set"], r["strength"], r["weight"], r["threshold"])
        assert r["inner_score"] == pytest.approx(scores[mine], abs=0.02) and scores[mine] <= min(scores.values()) + 0.02
        s, c, w, t = mine
        p = plain(x[train], y[train], c, w == "balanced", index[s])(x[test])
        assert r["n"] == len(test) and r["heldout_score"] == pytest.approx(score(test, p >= t), abs=0.03)


def test_models_share_the_products_of_features():
    """Loss, gradient and Hessian of a model in its own scale, from sums in the shared one; 700 rows pass a block."""
    r = np.random.default_rng(3)
    x, y, w = r.normal(size=(700, 3)) * [1, 5, 0.1] + [2, -7, 0], r.integers(0, 2, 700), r.normal(size=4)
    scale = R.Scaling(np.zeros((2, 3)), np.array([[2.0, -7, 0], [1, -6, 0.1]]), np.array([[1.0, 5, 0.1], [2, 4, 0.2]]), np.array([5.0, 5]), np.array([2.0, 2]))
    shared, use = R.Shared(scale, 3), np.arange(4)
    for t in (0, 1):
        model = R.Model(t, (0, 1, 2), 1.0, False)
        own = shared.weights(w[None], [model])
        total = sum(R._sums(shared.apply(x[y == k], None), bool(k), own)[0] for k in (0, 1))
        loss, gradient, hessian = shared.scaled(total, t, use)
        z = scale.apply(x, t)
        p = 1 / (1 + np.exp(-z @ w))
        assert np.isclose(loss, -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        assert np.allclose(gradient, z.T @ (p - y)) and np.allclose(hessian, z.T @ (z * (p * (1 - p))[:, None]))
