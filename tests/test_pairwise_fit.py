import numpy as np
import pytest
from pyspark.sql import functions as F

from prefrank.operators import models as L, pairwise_fit
from prefrank.operators.pairs import band_rows, difference_pairs, tournament_scores

SCHEMA = "category string, subset string, item long, true_score double, x array<double>, std double, n int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(90):
        x = rng.normal(size=3)
        category = None if i % 9 == 0 else f"c{i % 3}" if i < 70 else f"d{i}"
        out.append((category, "ab"[i % 2], i, float(np.round(x @ [1, -1, .5] + rng.normal(), 1)), x.tolist(), float(rng.uniform(.2, 2)) if i % 7 else 0.0, int(rng.integers(1, 9))))
    return out


def listed(rows, scheme, key):
    """Every ordered pair better - worse, with its weight."""
    d, w = [], []
    for a in rows:
        for b in rows:
            if key(a) == key(b) and a[3] > b[3] and a[2] != b[2]:
                v = [r[5] ** 2 / max(r[6], 1) for r in (a, b)]
                t = (a[3] - b[3]) / np.sqrt(sum(v)) if sum(v) else None
                d.append(np.subtract(a[4], b[4]))
                w.append(1.0 if scheme == "none" else a[3] - b[3] if scheme == "score_diff" else 1.0 if t is None else min(t, 5.0))
    return np.array(d).reshape(-1, 3), np.array(w)


def best(d, w, c=1.0):
    """Plain Newton on the listed pairs."""
    coef = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ coef))
        grad = coef / c - 2 * (w * p) @ d
        coef = coef - np.linalg.solve(np.eye(3) / c + 2 * (d.T * (w * p * (1 - p))) @ d, grad)
    return coef


@pytest.mark.parametrize("scheme", ["none", "score_diff", "t_stat"])
@pytest.mark.parametrize("tile", [4096, 5])
def test_same_coefficients_as_the_listed_pairs(spark, rows, scheme, tile):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    coef, pairs = pairwise_fit.fit(df, "x", None, ["category"], scheme=scheme, tile=tile)[""]
    d, w = listed(rows, scheme, lambda r: r[0])
    assert pairs == 2 * len(d)
    np.testing.assert_allclose(coef, best(d, w), rtol=1e-7, atol=1e-9)


def test_p_value_weights_follow_the_pair_table(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    table = difference_pairs(df, "x", scheme="p_value").where("label = 1").collect()
    want = best(np.array([r["diff"] for r in table]), np.array([r["weight"] for r in table]))
    np.testing.assert_allclose(L.pairwise_logistic(df, "x", weight="p_value"), want, rtol=1e-7)


def test_blocks_inside_a_task(spark, rows, monkeypatch):
    one = [("c", *r[1:]) for r in rows]
    side = {}
    pdf = spark.createDataFrame(one, SCHEMA).select(F.lit("g").alias("_g"), F.lit("").alias("_m"), F.lit("s0").alias("_slot"), F.lit(0).alias("_side"), F.col("item").alias("_i"), F.col("true_score").alias("_y"),
                                                    F.col("x").alias("_x"), F.col("std").alias("_std"), F.col("n").alias("_n")).toPandas()
    coef = np.array([.3, -.2, .1])
    found = {}
    pairwise_fit.slot_sums(pdf, {"": coef}, "t_stat", found)
    side["whole"] = found.pop("")
    monkeypatch.setattr(pairwise_fit, "BLOCK", 7)
    monkeypatch.setattr(pairwise_fit, "PACK", 7)
    pairwise_fit.slot_sums(pdf, {"": coef}, "t_stat", found)
    side["cut"] = found.pop("")
    for name in ("hess", "grad", "rest"):
        np.testing.assert_allclose(getattr(side["cut"], name), getattr(side["whole"], name), rtol=1e-10, atol=1e-9)


def test_subsets_in_one_fit(spark, rows):
    df = spark.createDataFrame([*rows, ("lone", "c", 900, 1.0, [0.0, 0.0, 0.0], 1.0, 1), ("lone", None, 901, 1.0, [9.0, 0.0, 0.0], 1.0, 1)], SCHEMA)
    got = L.hierarchical_logistic(df, "x", "subset", weight="score_diff")
    fits = {}
    for s in "ab":
        d, w = listed([r for r in rows if r[1] == s], "score_diff", lambda r: r[0])
        fits[s] = best(d, w), 2 * len(d)
    total, a = sum(n for _, n in fits.values()), np.median([n for _, n in fits.values()])
    mean = sum(coef * n / total for coef, n in fits.values())
    assert set(got) == {"a", "b", "c", None}
    for s, (coef, n) in fits.items():
        np.testing.assert_allclose(got[s], (n * coef + a * mean) / (a + n), rtol=1e-7)
    np.testing.assert_allclose([got["c"], got[None]], [mean, mean], rtol=1e-7)


def test_ties_repeats_nulls_and_empty(spark):
    tied = [("c", "a", 1, 2.0, [1.0, 0.0, 0.0], None, None), ("c", "a", 2, 2.0, [0.0, 1.0, 0.0], None, None), ("c", "a", 1, 3.0, [5.0, 0.0, 0.0], None, None), ("d", "a", 3, None, [1.0, 1.0, 1.0], None, None), ("d", "a", None, 1.0, [1.0, 1.0, 1.0], None, None), ("d", "a", 4, 9.0, None, None, None)]
    df = spark.createDataFrame(tied, SCHEMA)
    coef, pairs = pairwise_fit.fit(df, "x", None, scheme="t_stat")[""]
    assert pairs == 2 and np.allclose(coef, best(np.array([[5.0, -1.0, 0.0]]), np.ones(1)))
    assert (pairwise_fit.fit(df.where("item = 1"), "x", None)[""][0] == 0).all()
    assert pairwise_fit.fit(df.limit(0), "x", None) == {} and list(L.hierarchical_logistic(df.limit(0), "x", "subset")) == [None]
    with pytest.raises(ValueError):
        pairwise_fit.fit(df, "x", None, scheme="other")


def test_no_row_per_pair(spark, rows):
    """Rows sent to tasks grow with the chunks of a group, not with its pairs."""
    df = spark.createDataFrame([("c", "a", i, float(i), [1.0], None, None) for i in range(400)], SCHEMA)
    d = df.select("category", F.lit("").alias("_m"), F.col("item").alias("_i"), F.col("true_score").alias("_y"))
    sent = pairwise_fit.slotted(d, ["category"], tile=4)
    assert band_rows(400, 4) == 10 and sent.count() == 400 * 40
    slots = sent.groupBy("_slot").agg(F.countDistinct("_side").alias("sides")).collect()
    assert len(slots) <= 40 * 41 / 2


def test_bands_grow_with_the_root():
    assert band_rows(1000) == 4096
    assert band_rows(100_000_000) == 160_000


def test_tournament_in_bands(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=60)
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(s)], "category string, item long, s double")
    got = {r["item"]: r["tournament_score"] for r in tournament_scores(df, df, "s", tile=8).collect()}
    for i in range(60):
        assert abs(got[i] - (1 / (1 + np.exp(-(s[i] - s)))).sum()) < 1e-9


def test_small_groups_are_met_without_blocks(spark, monkeypatch):
    """Rows of small groups meet the next ones, whatever batches they come in; groups beyond PACK still go by blocks."""
    rng = np.random.default_rng(6)
    rows = [(f"g{g}", "ab"[g % 2], int(rng.integers(0, 9)), float(rng.integers(0, 4)), rng.normal(size=3).tolist(), float(rng.uniform(.2, 2)) if g % 5 else None, int(rng.integers(1, 9)))
            for g in range(60) for _ in range(1 + g % 7 + 90 * (g == 33))]
    df = spark.createDataFrame(rows, SCHEMA)
    for scheme in ("none", "t_stat"):
        held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        try:
            found = pairwise_fit.fit(df, "x", "subset", ["category"], scheme=scheme)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
        for s in "ab":
            mine = [(*r[:5], r[5] or 0.0, r[6]) for r in rows if r[1] == s]
            d, w = listed(mine, scheme, lambda r: r[0])
            assert found[s][1] == 2 * len(d)
            np.testing.assert_allclose(found[s][0], best(d, w), rtol=1e-7, atol=1e-9)

    def no_blocks(*_):
        raise AssertionError("compared block by block")

    table = df.where("category <> 'g33'").selectExpr("category AS _g", "subset AS _m", "item AS _i", "true_score AS _y", "x AS _x", "std AS _std", "cast(n AS double) AS _n").orderBy("_g").toArrow()
    monkeypatch.setattr(pairwise_fit.Sums, "add", no_blocks)
    out = {}
    pairwise_fit.group_sums(table.combine_chunks().to_batches()[0], {s: np.zeros(3) for s in "ab"}, "none", out)
    for s in "ab":
        assert out[s].rest[2] == 2 * len(listed([(*r[:5], 0.0, 1) for r in rows if r[1] == s and r[0] != "g33"], "none", lambda r: r[0])[0])
