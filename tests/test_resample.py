import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefrank.functions.stats import chi2_one_upper, f_upper, t_two_sided
from prefrank.operators import metrics as M, resample as B
from prefrank.operators.concordance import item_credit


def credit(a, b, tol=1e-10):
    a, b = ([math.nan if v is None else v for v in r] for r in (a, b))
    if abs(a[0] - b[0]) < tol or abs(a[1] - b[1]) < tol:
        return .5
    return float((a[0] - b[0]) * (a[1] - b[1]) > 0)


def oof_rows(n=60):
    rng = np.random.default_rng(5)
    return [("m", "hot" if i % 4 else "small", i, float(rng.integers(0, 9)), None if i % 19 == 3 else float(rng.integers(0, 7))) for i in range(n)]


@pytest.fixture
def oof(spark):
    return spark.createDataFrame(oof_rows(), "model string, category string, item long, true_score double, predicted_score double")


def brute_accuracy(rows):
    c = p = 0.0
    for a, b in itertools.combinations(rows, 2):
        if a[1] == b[1]:
            c, p = c + credit(a[3:], b[3:]), p + 1
    return c / p


@pytest.mark.parametrize("limit", ["1000000", "20"])
def test_jackknife_equals_refits(spark, oof, limit):
    spark.conf.set("spark.prefrank.groupRows", limit)
    try:
        got = {r["item"]: r["value"] for r in B.jackknife_accuracy(oof).collect()}
    finally:
        spark.conf.unset("spark.prefrank.groupRows")
    rows = oof_rows()
    for r in rows:
        assert got[r[2]] == pytest.approx(brute_accuracy([q for q in rows if q[2] != r[2]]), abs=1e-12)


def test_bootstrap_value_equals_listed_copies(oof):
    w = {(r["rep"], r["item"]): r["w"] for r in B.bootstrap_weights(oof, ["category"], "item", 3, 1).collect()}
    got = {r["rep"]: r["value"] for r in B.bootstrap_accuracy(oof, 3, 1).collect()}
    for rep in range(3):
        rows = [r for r in oof_rows() for _ in range(w.get((rep, r[2]), 0))]
        assert len(rows) == 60
        assert got[rep] == pytest.approx(brute_accuracy(rows), abs=1e-12)


def test_draws_ignore_row_order_and_partitions(oof):
    key = lambda d: sorted(map(tuple, B.bootstrap_weights(d, ["category"], "item", 4, 9).collect()))
    assert key(oof) == key(oof.orderBy(F.desc("item")).repartition(7))


def test_metrics_ignore_rekeying(oof):
    want = M.category_metrics(oof).orderBy("category").collect()
    other = oof.withColumn("item", F.lit(1000) - F.col("item")).repartition(3)
    assert M.category_metrics(other).orderBy("category").collect() == want


def bca(obs, boot, jack, variant, alpha=.05):
    nd = NormalDist()
    boot, jack = np.array(boot), np.array(jack)
    p = (boot < obs).mean() + (.5 * (boot == obs).mean() if variant == "midp" else 0)
    clip = {"strict": 1e-10, "midp": 0, "filtered": 1e-6}[variant]
    z0 = nd.inv_cdf(min(max(p, clip), 1 - clip))
    d = jack.mean() - jack
    a = (d ** 3).sum() / (6 * (d ** 2).sum() ** 1.5)
    q = [nd.cdf(z0 + (z0 + nd.inv_cdf(l)) / (1 - a * (z0 + nd.inv_cdf(l)))) for l in (alpha / 2, 1 - alpha / 2)]
    return np.quantile(boot, q)


@pytest.mark.parametrize("variant", ["strict", "midp", "filtered"])
def test_bca_interval(spark, variant):
    rng = np.random.default_rng(2)
    boot, jack, obs = rng.normal(size=200).round(2), rng.exponential(size=40), 0.11
    f = lambda v: spark.createDataFrame([("k", float(x)) for x in v], "key string, value double")
    r = B.bca_interval(f([obs]), f(boot), f(jack), ["key"], variant).first()
    np.testing.assert_allclose([r["lo"], r["hi"]], bca(obs, boot, jack, variant), rtol=1e-6)


def test_filtered_interval_needs_ten_draws(spark):
    f = lambda v: spark.createDataFrame([("k", float(x)) for x in v], "key string, value double")
    r = B.bca_interval(f([.5]), f([.1, .9]), f([.2, .3]), ["key"], "filtered").first()
    assert r["lo"] is None and r["hi"] is None


def test_tail_probabilities(spark):
    d = spark.createDataFrame([(2.0, 10.0, 3.0)], "x double, a double, b double")
    r = d.select(t_two_sided("x", "a").alias("t"), f_upper("x", "a", "b").alias("f"), chi2_one_upper("x").alias("c")).first()

    def integral(fn, lo, hi, n=400_000):
        x = np.linspace(lo, hi, n + 1)
        m = (x[1:] + x[:-1]) / 2
        return fn(m).sum() * (hi - lo) / n

    g = math.gamma
    t = lambda x: g(5.5) / (math.sqrt(10 * math.pi) * g(5)) * (1 + x * x / 10) ** -5.5
    f = lambda x: (g(6.5) / (g(5) * g(1.5))) * (10 / 3) ** 5 * x ** 4 / (1 + 10 * x / 3) ** 6.5
    assert r["t"] == pytest.approx(1 - 2 * integral(t, 0, 2), abs=1e-6)
    assert r["f"] == pytest.approx(1 - integral(f, 0, 2), abs=1e-6)
    assert r["c"] == pytest.approx(1 - 2 * (NormalDist().cdf(math.sqrt(2)) - .5), abs=1e-9)


def test_benjamini_hochberg(spark):
    p = [.001, .008, .039, .041, .042, .06, .074, .205, .212, .216]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {r["i"] for r in B.benjamini_hochberg(d, "p", .05).filter("significant").collect()}
    assert got == {0, 1}


def test_item_credit_sums_to_group_credit(oof):
    got = {r["category"]: r["s"] / 2 for r in item_credit(oof, ["category"], "true_score", "predicted_score").groupBy("category").agg(F.sum("credit").alias("s")).collect()}
    want = {r["category"]: r["correct"] for r in M.pairwise_accuracy(oof, ["category"]).collect()}
    assert got == pytest.approx(want)
