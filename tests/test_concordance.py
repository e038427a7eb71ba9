import itertools

import numpy as np
import pandas as pd
import pytest

from prefrank.operators.concordance import TOTALS, pair_totals
from prefrank.operators.skew import average_rank, rank_stats


def brute(pdf, tol, complete):
    out = {}
    for g, d in pdf.groupby("g"):
        rows = [(r.x, r.y) for r in d.itertuples() for _ in range(int(r.w)) if not complete or (pd.notna(r.x) and pd.notna(r.y))]
        t = dict.fromkeys(TOTALS, 0.0)
        for (xi, yi), (xj, yj) in itertools.combinations(rows, 2):
            tx = abs(xi - xj) < tol if tol else xi == xj
            ty = abs(yi - yj) < tol if tol else yi == yj
            t["n_pairs"] += not np.isnan([xi, yi, xj, yj]).any()
            t["ties_x"] += tx
            t["ties_y"] += ty
            t["ties_xy"] += tx and ty
            t["same_way"] += (not tx) and (not ty) and (xi - xj) * (yi - yj) > 0
        out[g] = t
    return out


def frame(seed, n=300):
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "a", "b", "c"], size=n, p=[.5, .3, .15, .05])
    x = rng.integers(0, 6, n).astype(float) if seed % 2 else rng.normal(size=n).round(2)
    y = rng.normal(size=n).round(1)
    y[rng.random(n) < .05] = np.nan
    x = x + rng.choice([0, 1e-13], n)
    return pd.DataFrame({"g": g, "x": x, "y": y, "w": rng.integers(1, 4, n)})


def as_spark(spark, pdf):
    rows = [(r.g, float(r.x), None if pd.isna(r.y) else float(r.y), int(r.w)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "g string, x double, y double, w int")


def check(spark, seed, tol, complete=True):
    pdf = frame(seed)
    want = brute(pdf, tol, complete)
    got = {r["g"]: r.asDict() for r in pair_totals(as_spark(spark, pdf), ["g"], "x", "y", "w", tol, complete=complete).collect()}
    assert set(got) == set(want)
    for g, t in want.items():
        for c in TOTALS:
            assert got[g][c] == t[c], (g, c)


@pytest.mark.parametrize("seed,tol", [(1, 1e-10), (2, 1e-10), (2, 0.0)])
def test_totals_small_groups(spark, seed, tol):
    check(spark, seed, tol)
    check(spark, seed, tol, complete=False)


@pytest.mark.parametrize("seed,tol,complete", [(1, 1e-10, False), (4, 0.0, True)])
def test_totals_hot_group_in_strips(spark, tiny_groups, seed, tol, complete):
    check(spark, seed, tol, complete)


@pytest.mark.parametrize("descending", [False, True])
def test_rank_stats_hot_equals_window(spark, tiny_groups, descending):
    pdf = frame(3)
    got = (rank_stats(as_spark(spark, pdf), ["g"], "y", descending=descending)
           .select("g", "y", average_rank().alias("r")).toPandas().sort_values(["g", "y", "r"]))
    ref = pdf.assign(r=pdf.groupby("g").y.rank(method="average", ascending=not descending)).sort_values(["g", "y", "r"])
    np.testing.assert_allclose(got["r"].to_numpy(float), ref["r"].to_numpy(float))
