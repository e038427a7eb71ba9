import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefrank.operators import models as L
from prefrank.operators.features import projected


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=30) * .3 + 2
    rows = [(i, f"c{i % 3}", [float(v) for v in x[i]], [float(x[i, 0])], float(y[i])) for i in range(30)]
    return x, y, spark.createDataFrame(rows, "item long, category string, x array<double>, z array<double>, true_score double").repartition(5)


def ridge(x, y, alpha=1.0):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return lambda q: (q - mx) @ w + my


def by_item(df, col):
    return np.array([r[col] for r in sorted(df.select("item", col).collect(), key=lambda r: r["item"])])


def test_ridge_and_leave_one_out(data):
    x, y, df = data
    np.testing.assert_allclose(by_item(L.ridge_scores(df, "x", L.ridge_fit(df, "x", "true_score")), "predicted_score"), ridge(x, y)(x))
    want = [ridge(np.delete(x, i, 0), np.delete(y, i))(x[i]) for i in range(30)]
    np.testing.assert_allclose(by_item(L.ridge_leave_one_out(df, "x", "true_score"), "predicted_score"), want)


def test_nested_ensemble_equals_refits(data):
    x, y, df = data
    views = [x, x[:, :1]]
    want = []
    for i in range(30):
        keep = [j for j in range(30) if j != i]
        inner = np.array([[ridge(np.delete(v, [i, j], 0), np.delete(y, [i, j]))(v[j]) for v in views] for j in keep])
        w = L.nnls_weights((inner.T @ inner)[None], (inner.T @ y[keep])[None])[0]
        outer = np.array([ridge(np.delete(v, i, 0), np.delete(y, i))(v[i]) for v in views])
        want.append(w @ outer)
    got = L.nested_ensemble(df, ["x", "z"], "true_score", tile=8)
    np.testing.assert_allclose(by_item(got, "predicted_score"), want, rtol=1e-8)


def test_nnls_beats_a_fine_grid():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=(15, 2)), rng.normal(size=15)
        w = L.nnls_weights((x.T @ x)[None], (x.T @ y)[None])[0]
        assert (w >= 0).all()
        grid = np.stack(np.meshgrid(*[np.linspace(0, 3, 301)] * 2), -1).reshape(-1, 2)
        best = ((y[:, None] - x @ grid.T) ** 2).sum(0).min()
        assert ((y - x @ w) ** 2).sum() <= best + 1e-9


def test_pairwise_logistic_is_at_the_optimum(data):
    x, y, df = data
    w = L.pairwise_logistic(df, "x", ["category"])
    g = w.copy()
    for i in range(30):
        for j in range(30):
            if i % 3 == j % 3 and y[i] > y[j]:
                d = x[i] - x[j]
                g -= 2 * d / (1 + np.exp(d @ w))
    assert np.abs(g).max() < 1e-3


def test_hierarchical_shrinks_to_the_mean(data):
    _, _, df = data
    d = df.withColumn("subset", F.when(F.col("item") < 12, "a").otherwise("b"))
    w = L.hierarchical_logistic(d, "z", "subset", strength=1e12)
    np.testing.assert_allclose(w["a"], w[None], rtol=1e-6)
    far = L.hierarchical_logistic(d, "z", "subset", strength=0.0)
    assert abs(far["a"][0] - far["b"][0]) > 1e-6


def test_partial_least_squares(data):
    x, y, df = data
    got = np.array([r["pls"] for r in sorted(L.partial_least_squares(df, "x", "true_score", 2).collect(), key=lambda r: r["item"])])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    r, s = y - y.mean(), []
    for _ in range(2):
        w = z.T @ r
        w /= np.linalg.norm(w)
        t = z @ w
        p = z.T @ t / (t @ t)
        z, r = z - np.outer(t, p), r - t * (r @ t) / (t @ t)
        s.append(t)
    np.testing.assert_allclose(got, np.array(s).T, atol=1e-8)


def test_projection_matches_svd(data):
    x, _, df = data
    got = np.array([r["pc"] for r in sorted(projected(df, "x", None, 2).collect(), key=lambda r: r["item"])])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_linear_probe_learns(data):
    _, _, df = data
    d = df.withColumn("y", (F.col("true_score") > 2).cast("double"))
    model = L.linear_probe(d, "x", "y", 10.0)
    assert model.summary.accuracy > .9


def test_boosted_trees_cover_every_item(data):
    _, _, df = data
    out = L.boosted_trees_oof(df, "x", "true_score", "item", folds=2, rounds=3, max_leaves_depth=2)
    assert sorted(r["item"] for r in out.select("item").collect()) == list(range(30))


def test_weighted_pairwise_logistic_is_stationary(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(14, 2))
    y = x[:, 0] + rng.normal(size=14)
    std, n = rng.uniform(0.5, 2, 14), rng.integers(2, 9, 14)
    df = spark.createDataFrame([(i % 2, i, float(y[i]), x[i].tolist(), float(std[i]), int(n[i])) for i in range(14)], "category int, item int, true_score double, x array<double>, std double, n int")
    for scheme in ("score_diff", "t_stat"):
        w = L.pairwise_logistic(df, "x", weight=scheme)
        gradient = w.copy()
        for i in range(14):
            for j in range(14):
                if i % 2 == j % 2 and y[i] > y[j]:
                    se = np.sqrt(std[i] ** 2 / n[i] + std[j] ** 2 / n[j])
                    weight = y[i] - y[j] if scheme == "score_diff" else min((y[i] - y[j]) / se, 5)
                    gradient -= 2 * weight * (x[i] - x[j]) / (1 + np.exp(w @ (x[i] - x[j])))
        assert np.abs(gradient).max() < 1e-3


def test_nested_ensemble_from_moments_equals_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=400) + 3
    rows = [("c", i, float(y[i]), x[i, :3].tolist(), x[i, 2:].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "category string, item int, true_score double, x array<double>, z array<double>").repartition(3)
    pairs = L.nested_ensemble(df, ["x", "z"], "true_score", tile=100)
    want, weights = by_item(pairs, "predicted_score"), by_item(pairs, "weights")

    def no_pairs(*_):
        raise AssertionError("pairs of rows met")

    monkeypatch.setattr(L, "SLACK", 1.0)  # 400 rows are too few for the usual one
    monkeypatch.setattr(L, "_tiled", no_pairs)
    got = L.nested_ensemble(df, ["x", "z"], "true_score")
    np.testing.assert_allclose(by_item(got, "predicted_score"), want, rtol=1e-6)
    np.testing.assert_allclose(np.stack(by_item(got, "weights")), np.stack(weights), rtol=1e-5, atol=1e-6)
    with pytest.raises(AssertionError, match="pairs of rows met"):  # rows of one item never meet
        L.nested_ensemble(df.unionByName(df.limit(1)), ["x", "z"], "true_score")
    assert L.beyond_moments(0.01, 1.0, 1.0, 1.0) < 1e-3 and L.beyond_moments(0.6, 1.0, 1.0, 1.0) == np.inf
