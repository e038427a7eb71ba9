"""Fit and transform: every fold against a refit on the other rows."""

import numpy as np
import pytest

from prefrank.operators import preparation as P


def refit(train, rows, plan):
    """The same by hand: scale, then project the scaled values of wide vectors (or the other way round)."""
    mean, sd = train.mean(0), train.std(0)
    shift, scale = {"none": (0 * mean, 0 * mean + 1), "standard": (mean, sd), "minmax": (train.min(0), np.ptp(train, 0)),
                    "robust": (np.median(train, 0), np.subtract(*np.percentile(train, [75, 25], axis=0)))}[plan.scaler]
    scale = np.where(scale > 1e-12, scale, 1)
    if plan.scale_last:
        shift, scale = 0 * mean, 0 * mean + 1
    z, out = (train - shift) / scale, (rows - shift) / scale
    if train.shape[1] > plan.wide:
        middle = z.mean(0)
        _, d, axes = np.linalg.svd(z - middle, full_matrices=False)
        share = np.cumsum(d**2) / (d**2).sum()
        k = plan.k or int(np.searchsorted(share, plan.variance - 1e-12)) + 1
        axes = axes[:k] * np.where(axes[np.arange(len(axes[:k])), np.abs(axes[:k]).argmax(1)] < 0, -1, 1)[:, None]
        out = (out - middle) @ axes.T
        z = (z - middle) @ axes.T
    if plan.scale_last:
        out = (out - z.mean(0)) / z.std(0)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 14)) @ rng.normal(size=(14, 14)) * 3 + 1000
    v[:, 5] = 7.0
    return v


def table(spark, vectors):
    return spark.createDataFrame([(i, i % 4 if i % 9 else None, v.tolist(), 1) for i, v in enumerate(vectors)], "item int, fold int, vec array<double>, n int").repartition(5)


def check(rows, want):
    got = {r["item"]: r["vec"] for r in rows}
    assert set(got) == set(want)
    for i, w in want.items():
        assert np.allclose(got[i], w, atol=1e-6), (i, got[i], w)


@pytest.mark.parametrize("plan", [P.Plan(), P.Plan(k=3), P.Plan("none"), P.Plan(wide=99), P.Plan(k=5, scale_last=True)])
def test_folds_and_single_rows_equal_refits(spark, vectors, plan):
    df = table(spark, vectors)
    want = {}
    for i in range(90):
        fold = [j for j in range(90) if (j % 4 if j % 9 else None) != (i % 4 if i % 9 else None)]
        want[i] = refit(vectors[fold], vectors[i:i + 1], plan)[0]
    check(P.transform(df, P.fold_states(df, "fold", "vec", plan), "vec", ["fold"]).collect(), want)
    few = df.where("item < 30")
    check(P.leave_one_out(few, "vec", plan).collect(), {i: refit(np.delete(vectors[:30], i, 0), vectors[i:i + 1], plan)[0] for i in range(30)})


@pytest.mark.parametrize("plan", [P.Plan(), P.Plan("minmax", k=4), P.Plan("robust", wide=99), P.Plan(scale_last=True, k=2)])
def test_train_and_test(spark, vectors, plan):
    df = table(spark, vectors)
    got = P.transform(df.where("item >= 60"), P.fit(df.where("item < 60"), "vec", plan), "vec")
    check(got.collect(), dict(zip(range(60, 90), refit(vectors[:60], vectors[60:], plan))))


def test_a_row_changes_nothing_of_its_own_transform(spark, vectors):
    moved = vectors.copy()
    moved[8] += 1e4  # item 8 is the only one changed; it lies in fold 0
    a, b = ({r["fold"]: (r["shift"], r["scale"], r["axes"]) for r in P.fold_states(table(spark, v), "fold", "vec").collect()} for v in (vectors, moved))
    assert all(np.allclose(x, y, atol=1e-7) for x, y in zip(a[0], b[0])) and not np.allclose(a[1][0], b[1][0])


def test_unknown_values(spark):
    rows = [(0, 0, [1.0, None]), (1, 0, None), (2, 1, [2.0, 4.0]), (3, 1, [4.0, float("nan")]), (4, 2, [3.0, 6.0])]
    df = spark.createDataFrame(rows, "item int, fold int, vec array<double>")
    got = {r["item"]: r["vec"] for r in P.impute_held_out(df, "fold", "vec").collect()}
    assert got == {0: [1.0, 5.0], 1: None, 2: [2.0, 4.0], 3: [4.0, 6.0], 4: [3.0, 6.0]}
    out = {r["item"]: r["vec"] for r in P.transform(df, P.fold_states(df, "fold", "vec"), "vec", ["fold"]).collect()}
    assert out[0] is None and out[1] is None and out[3] is None and out[2] == [-1.0, -2.0] and out[4] == [1.0, 2.0]
    assert P.fit(df.limit(0), "vec").count() == 0 and P.fold_states(df.limit(0), "fold", "vec").count() == 0
    assert [r["vec"] for r in P.leave_one_out(df.where("item = 2"), "vec").collect()] == [None]
    with pytest.raises(ValueError):
        P.Plan("other")
