"""Items are known by category and code: codes may repeat across categories."""

import numpy as np

from prefrank.operators import features, models


def test_imputation_stays_in_its_category(spark):
    rows = []
    for category, base in ((1, 0.0), (2, 100.0)):
        rows += [(category, 0, [1.0, 0.0], None)] + [(category, i, [1.0, i / 10], [base + i]) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "category int, item int, a array<double>, b array<double>")
    got = {(r["category"], r["item"]): r["b"] for r in features.knn_imputed(df, ["a", "b"], 2).collect()}
    assert got[1, 0] == [1.5] and got[2, 0] == [101.5] and len(got) == 8


def test_imputation_without_complete_items_at_home(spark):
    rows = [(1, 0, [1.0, 0.0], None), (None, 0, [1.0, 0.1], None)] + [(c, i, [1.0, (i + c) / 10], [10.0 * c + i]) for c in (2, 3) for i in (0, 1)]
    df = spark.createDataFrame(rows, "category int, item int, a array<double>, b array<double>")
    got = {(r["category"], r["item"]): r["b"] for r in features.knn_imputed(df, ["a", "b"], 1).collect()}
    assert got[1, 0] == [20.0] and got[None, 0] == [20.0] and len(got) == 6


def test_nested_ensemble_with_repeated_codes(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(24, 2)), rng.normal(size=(24, 2))
    y = x[:, 0] + z[:, 1] + rng.normal(size=24) / 5
    rows = [(i % 2, i // 2, i, float(y[i]), x[i].tolist(), z[i].tolist()) for i in range(24)]
    df = spark.createDataFrame(rows, "category int, item int, unique int, y double, x array<double>, z array<double>")
    want = {r["unique"]: r["predicted_score"] for r in models.nested_ensemble(df, ["x", "z"], "y", "unique").collect()}
    got = {r["item"] * 2 + r["category"]: r["predicted_score"] for r in models.nested_ensemble(df, ["x", "z"], "y", ["category", "item"], tile=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
