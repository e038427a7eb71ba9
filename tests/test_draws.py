"""Draw matrices and the per-pair tie rule against brute force."""

import numpy as np
import pytest

from prefrank.operators import concordance, draws, metrics, resample as B


def credit(a, b, tol=1e-10):
    """None for an unknown score; each pair is judged on its own."""
    known = [(u, v) for u, v in zip(a, b)]
    gaps = [abs(u - v) if u is not None and v is not None else None for u, v in known]
    if any(g is not None and g < tol for g in gaps):
        return 0.5
    if None in gaps:
        return 0.0
    return float((a[0] - b[0]) * (a[1] - b[1]) > 0)


def chained(rng, n, step=0.6e-10):
    """Scores in runs of neighbours closer than the tolerance whose ends are further apart."""
    x = rng.choice([0.0, 0.25, 0.5], n) + step * rng.integers(0, 6, n)
    y = rng.choice([0.0, 0.5], n) + step * rng.integers(0, 5, n)
    return x, y


def test_six_items_in_a_chain(spark):
    rows = [("a", i, 0.6e-10 * i, float(i)) for i in range(6)]
    got = metrics.pairwise_accuracy(spark.createDataFrame(rows, "category string, item int, true_score double, predicted_score double"), ["category"]).first()
    assert (got["correct"], got["pairs"]) == (12.5, 15.0)


@pytest.mark.parametrize("seed", range(4))
def test_pair_rule_on_chained_values(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("p", "q", None):
        x, y = chained(rng, 60) if g != "q" else (rng.integers(0, 9, 60).astype(float), rng.random(60))
        for i in range(60):
            rows.append((g, i, None if rng.random() < 0.05 else float(x[i]), None if rng.random() < 0.05 else float(y[i])))
    df = spark.createDataFrame(rows, "category string, item int, true_score double, predicted_score double").repartition(3)
    acc = {r["category"]: r["correct"] for r in metrics.pairwise_accuracy(df, ["category"]).collect()}
    each = {(r["category"], r["item"]): r["credit"] for r in concordance.item_credit(df, ["category"], "true_score", "predicted_score").collect()}
    for g in ("p", "q", None):
        mine = [r for r in rows if r[0] == g]
        c = {(a[1], b[1]): credit(a[2:], b[2:]) for a in mine for b in mine if a[1] != b[1]}
        assert acc[g] == sum(c.values()) / 2
        assert all(each[g, a[1]] == sum(v for (i, _), v in c.items() if i == a[1]) for a in mine)


@pytest.mark.parametrize("square", [2048, 0])
def test_pair_sums_of_many_weightings(monkeypatch, square):
    monkeypatch.setattr(draws, "SQUARE", square)
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, y = chained(rng, 40)
        x[rng.random(40) < 0.1], y[rng.random(40) < 0.1] = np.nan, np.nan
        w = rng.integers(0, 4, (7, 40)).astype(float)
        correct, pairs = draws.pair_sums(x, y, w)
        for r in range(7):
            rows = [(None if np.isnan(x[i]) else x[i], None if np.isnan(y[i]) else y[i]) for i in range(40) for _ in range(int(w[r, i]))]
            assert correct[r] == sum(credit(a, b) for k, a in enumerate(rows) for b in rows[:k]) and pairs[r] == len(rows) * (len(rows) - 1) / 2


def test_draws_are_those_of_the_row_wise_operator(spark, tiny_groups):
    rng = np.random.default_rng(3)
    rows = [(m, c, i, float(rng.integers(0, 5)), float(rng.random()) if (i + len(m)) % 9 else None) for m in ("m", "mm") for c, n in (("a", 1), ("b", 12), (None, 15)) for i in range(n)]
    oof = spark.createDataFrame(rows, "model string, category string, item int, true_score double, predicted_score double")
    small = {(r["model"], r["rep"]): r["value"] for r in B.bootstrap_accuracy(oof, 30, 5).collect()}
    spark.conf.set("spark.prefrank.groupRows", "20")
    large = {(r["model"], r["rep"]): r["value"] for r in B.bootstrap_accuracy(oof, 30, 5).collect()}
    assert small == large and len(small) == 60
    df = oof.where("model = 'm' AND category IS NULL").select("item", "predicted_score")
    for limit in ("100", "3"):
        spark.conf.set("spark.prefrank.groupRows", limit)
        got = dict(map(tuple, B.bootstrap_median(df, "item", "predicted_score", 40, 2).collect()))
        first = got if limit == "100" else first
        assert got == pytest.approx(first, abs=1e-12)


def test_classifier_draws_equal_the_row_wise_operator(spark, tiny_groups):
    rng = np.random.default_rng(4)
    p = np.round(rng.dirichlet([1, 1, 1], 35), 1)
    probs = spark.createDataFrame([(i, int(rng.integers(0, 3)) if i else None, *map(float, v)) for i, v in enumerate(p)], "id int, y_true long, p0 double, p1 double, p2 double")
    results = []
    for limit in ("100", "20"):
        spark.conf.set("spark.prefrank.groupRows", limit)
        macro = {r["rep"]: r.asDict() for r in B.bootstrap_classifier(probs, "id", [0, 1, 2], ["p0", "p1", "p2"], 20, 5).collect()}
        per = {(r["rep"], r["label"]): r.asDict() for r in B.bootstrap_classifier(probs, "id", [0, 1, 2], ["p0", "p1", "p2"], 20, 5, per_class=True).collect()}
        means = {r["rep"]: r["p"] for r in B.bootstrap_means(probs, "id", {"p": probs.p0}, 20, 5).collect()}
        results.append((macro, per, means))
    for a, b in zip(*results):
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-12, nan_ok=True)
