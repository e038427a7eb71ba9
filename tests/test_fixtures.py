"""Small hand-checked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefrank.functions import numeric as N, text as X
from prefrank.operators import classify as C, conform, datasets as K, entity as E, gates as G, panel as H
from prefrank.operators.pairs import item_pairs, labelled_pairs, matched_submission, tournament_scores
from prefrank.operators.skew import row_index
from prefrank.plans import ORACLES, QUERIES


def test_weighted_and_max_pooling(spark):
    vec = spark.createDataFrame([("e", [1., 0., 0., 0.]), ("a", [0., 1., 0., 0.]), ("b", [0., 0., 1., 0.])], "compound string, vec array<double>")
    recipe = spark.createDataFrame([(1, 0, "water"), (1, 1, "salt")], "product long, pos long, ingredient string")
    one = spark.createDataFrame([("water", "e", None), ("salt", "a", None)], "ingredient string, compound string, concentration double")
    got = E.product_vectors(recipe, E.ingredient_vectors(one, vec, "mean")).first()["vec"]
    np.testing.assert_allclose(got, [2 / 3, 1 / 3, 0, 0])
    two = spark.createDataFrame([("water", "e", None), ("water", "b", None), ("salt", "a", None)], "ingredient string, compound string, concentration double")
    got = E.product_vectors(recipe, E.ingredient_vectors(two, vec, "max")).first()["vec"]
    np.testing.assert_allclose(got, [2 / 3, 1 / 3, 2 / 3, 0])


def probs(spark, rows):
    return spark.createDataFrame([(y, *[float(v) for v in p]) for y, p in rows], "y_true int, " + ", ".join(f"p{i} double" for i in range(5)))


P5 = [f"p{i}" for i in range(5)]


def test_perfect_and_single_class_predictors(spark):
    d = probs(spark, [(i, np.eye(5)[i]) for i in range(5)])
    r = C.macro_scores(C.class_scores(C.confusion(d, P5, range(5)), range(5))).first()
    assert (r["accuracy"], r["f1"], r["weighted_f1"]) == (1, 1, 1)
    d = probs(spark, [(0, np.eye(5)[0])] * 8 + [(1, np.eye(5)[0])] * 2)
    per = {r["label"]: r for r in C.class_scores(C.confusion(d, P5, range(5)), range(5)).collect()}
    assert per[1]["recall"] == per[1]["f1"] == 0 and per[0]["recall"] == 1


def test_calibration_and_absent_class(spark):
    p = [.9, .025, .025, .025, .025]
    d = probs(spark, [(0, p)] * 90 + [(1, p)] * 10)
    assert C.expected_calibration_error(d, P5).first()["ece"] < .05
    auc = {r["label"]: r["auroc"] for r in C.one_vs_rest_auc(d, P5).collect()}
    assert auc[0] == .5 and auc[3] is None and auc[4] is None


def test_unknown_label_is_an_error(spark):
    d = spark.createDataFrame([("odd",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        d.select(C.encoded(F.col("label"), ["a"])).collect()


def test_gates_raise(spark):
    d = spark.createDataFrame([("x", "sweet"), ("y", "bitter")], "id string, label string")
    with pytest.raises(G.GateError):
        G.enforce(G.leakage(d, d, ["id"]), "leakage")
    with pytest.raises(G.GateError):
        G.enforce(G.class_drift(d, "label", {"sweet": 10, "bitter": 1}, 5), "drift")
    G.enforce(G.class_drift(d, "label", {"sweet": 3, "bitter": 1}, 5), "drift")
    with pytest.raises(ValueError):
        matched_submission(d.limit(1), d.select("id"), "id")


def greedy(sizes, n, val, test):
    used, out = {"val": 0, "test": 0}, {"val": 0, "test": 0, "train": 0}
    for s in sorted(sizes, reverse=True):
        for part, cap in (("val", int(n * val)), ("test", int(n * test))):
            if used[part] + s <= cap:
                used[part] += s
                out[part] += s
                break
        else:
            out["train"] += s
    return out


def test_group_split_equals_greedy_fill(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 25)
    rows = [(f"g{g}", i) for g, s in enumerate(sizes) for i in range(s)]
    d = K.group_split(spark.createDataFrame(rows, "g string, i long"), "g", .2, .15, 1)
    got = {r["split"]: r["n"] for r in d.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in greedy(sizes, len(rows), .2, .15).items() if v}
    assert d.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_pairs_of_split_groups_are_complete(spark):
    d = spark.range(40).select(F.lit("a").alias("category"), F.col("id").alias("item"), (F.col("id") % 5).cast("double").alias("true_score"))
    p = item_pairs(d, ["category"], "item", [], tile=7)
    assert p.count() == p.distinct().count() == 40 * 39 // 2
    assert labelled_pairs(d).count() == 40 * 39 // 2 - 5 * (8 * 7 // 2)
    s = d.withColumn("s", F.col("item") / 10.0)
    a = {r["item"]: r["tournament_score"] for r in tournament_scores(s, s, "s", tile=7).collect()}
    v = np.arange(40) / 10
    np.testing.assert_allclose([a[i] for i in range(40)], (1 / (1 + np.exp(-(v[:, None] - v[None]))).astype(float)).sum(1))


def test_hot_row_numbers_by_a_struct(spark, tiny_groups):
    d = spark.range(300).select(F.lit(1).alias("g"), F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("o"))
    got = [r["n"] for r in row_index(d, ["g"], "o", "n").orderBy("o").collect()]
    assert got == list(range(300))


def test_hot_quantiles(spark, tiny_groups):
    d = spark.range(500).select(F.lit(1).alias("g"), (F.col("id") * F.col("id") % 97).cast("double").alias("v"))
    q = conform.quantiles(d, ["g"], "v", [.025, .5, .9]).first()["q"]
    np.testing.assert_allclose(q, np.quantile(np.array([i * i % 97 for i in range(500)]), [.025, .5, .9]))


def test_rater_agreement_closed_form(spark):
    d = spark.createDataFrame([(2, 1, 1)], "n_pos long, n_neg long, n_tie long")
    assert H.rater_pair_agreement(d).first()["agreement"] == pytest.approx((1 + .5 * 3) / 6)


def test_interpolated_k(spark):
    d = spark.createDataFrame([(1, .5), (2, .6), (3, .8)], "k int, accuracy double")
    assert H.interpolated_k(d, .7).first()["k_star"] == pytest.approx(2.5)


@pytest.mark.parametrize("text,want", [("reason 1\n2.", "2"), ("1\nnone", "1"), ("  ", None), ("1 or 2", "2")])
def test_parse_answer(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_answer(F.col("t")).alias("a")).first()["a"] == want


def test_one_decimal_follows_the_binary_value(spark):
    v = [0.15, 0.25, 0.35, 1126.25, 2.675, 0.05, 7.0, 0.45]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(N.one_decimal(F.col("x"))).collect()]
    assert got == [f"{x:.1f}" for x in v]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [set(rng.choice(30, 8, replace=False)) for _ in range(4)]
    sets = [(i, "c", sorted({str(t) for t in (b ^ {int(rng.integers(30))})})) for i in range(120) for b in [base[i % 4]]]
    d = spark.createDataFrame(sets, "item long, category string, tokens array<string>")
    got = {r["item"]: r["match"] for r in K.near_duplicates(d.filter("item % 2 = 1"), d.filter("item % 2 = 0"), .8).collect()}
    want = {}
    for i, _, a in sets:
        if i % 2:
            m = [j for j, _, b in sets if j % 2 == 0 and len(set(a) & set(b)) >= .8 * len(set(a) | set(b))]
            if m:
                want[i] = min(m)
    assert got == want


def test_every_registered_query_has_a_name_and_reads_tables():
    assert len(QUERIES) > 180 and set(ORACLES) <= set(QUERIES)
