"""Model, ensemble and sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.operators import metrics as M, models as L
from prefrank.operators.ranking import add_rank_pct, best_by
from prefrank.plans.q_metrics import MM, PC_MULTI
from prefrank.plans.registry import query


def rounded(d, *cols):
    return d.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in d.columns])


ONE = "WITH f AS (SELECT category, item, true_score AS y, predicted_score / 1000000 AS x FROM oof), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM f)"


def _one(t):
    return t.oof.select("category", "item", F.col("true_score").alias("y"), F.array(F.col("predicted_score") / F.lit(1000000.0)).alias("x"))


@query("d4_ridge", uses="oof", oracle=ONE + """,
    w AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS w, sx / n AS mx, sy / n AS my FROM s)
    SELECT category, item, round(my + w * (x - mx), 6) AS predicted_score FROM f, w""")
def _(t):
    d = _one(t)
    return rounded(L.ridge_scores(d, "x", L.ridge_fit(d, "x", "y", 1.0)).select("category", "item", "predicted_score"), "predicted_score")


@query("d8_ridge_leave_one_out", uses="oof", oracle=ONE + """,
    l AS (SELECT category, item, x, n - 1 AS n, sx - x AS sx, sy - y AS sy, sxx - x * x AS sxx, sxy - x * y AS sxy FROM f, s)
    SELECT category, item, round(sy / n + (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) * (x - sx / n), 6) AS predicted_score FROM l""")
def _(t):
    return rounded(L.ridge_leave_one_out(_one(t), "x", "y").select("category", "item", "predicted_score"), "predicted_score")


def _two(t):
    v = F.col("vec").cast("array<double>")
    return t.items_vec.select("category", "item", F.col("category").cast("double").alias("y"), F.slice(v, 1, 32).alias("a"), F.slice(v, 33, 32).alias("b"))


@query("d4_ridge_vectors")
def _(t):
    d = _two(t)
    return rounded(L.ridge_scores(d, "a", L.ridge_fit(d, "a", "y", 1.0)).select("category", "item", "predicted_score"), "predicted_score")


@query("d5_pairwise_logistic")
def _(t):
    d = t.order_items.withColumn("x", F.array(F.col("predicted_score"), F.col("item").cast("double")))
    w = L.pairwise_logistic(d, "x")
    return rounded(L.ridge_scores(d, "x", [*w, 0.0], "score").select("category", "item", "score"), "score")


@query("d6_hierarchical_logistic")
def _(t):
    d = t.order_items.withColumn("x", F.array(F.col("predicted_score"), F.col("item").cast("double"))).withColumn(
        "subset", F.when(F.col("category").cast("long") % 5 == 0, "small").otherwise("large"))
    w = L.hierarchical_logistic(d, "x", "subset")
    out = None
    for s in ("small", "large"):
        part = L.ridge_scores(d.filter(F.col("subset") == s), "x", [*w[s], 0.0], "score")
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("category", "item", "score"), "score")


@query("d7_boosted_trees")
def _(t):
    return rounded(L.boosted_trees_oof(_two(t), "b", "y", ["category", "item"], folds=2, rounds=4, max_leaves_depth=3).select("category", "item", "predicted_score"), "predicted_score")


@query("d9_nested_ensemble")
def _(t):
    return rounded(L.nested_ensemble(_two(t), ["a", "b"], "y", ["category", "item"]).select("item", "true_score", "predicted_score"), "predicted_score")


NN = """
    WITH f AS (SELECT category, item, true_score AS y, {x1} AS a, {x2} AS b FROM {src}),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM f),
    l AS (SELECT category, item, a, b, aa - a * a AS aa, ab - a * b AS ab, bb - b * b AS bb, ay - a * y AS ay, by_ - b * y AS cy FROM f, s),
    w AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS w1, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS w2 FROM l)
    SELECT category, item, round(CASE WHEN w1 >= 0 AND w2 >= 0 THEN w1 * a + w2 * b
      WHEN greatest(ay, 0) * greatest(ay, 0) / aa >= greatest(cy, 0) * greatest(cy, 0) / bb THEN greatest(ay, 0) / aa * a ELSE greatest(cy, 0) / bb * b END, 6) AS predicted_score FROM w
"""


@query("d10_nnls_leave_one_out", uses="stats_multi", oracle=NN.format(x1="price / 1000000", x2="-tax", src="stats_multi"))
def _(t):
    d = t.stats_multi.select("category", "item", F.col("true_score").alias("y"), (F.col("price") / F.lit(1000000.0)).alias("a"), (-F.col("tax")).alias("b"))
    return rounded(L.nnls_leave_one_out(d, ["a", "b"], "y").select("category", "item", "predicted_score"), "predicted_score")


PCT = "(rank() OVER (PARTITION BY category ORDER BY {c}) + (count(*) OVER (PARTITION BY category, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY category)"


@query("d11_nnls_rank_percentiles", uses="stats_multi", oracle=NN.format(x1="a", x2="b", src=f"(SELECT *, {PCT.format(c='price')} AS a, {PCT.format(c='tax')} AS b FROM stats_multi)"))
def _(t):
    d = t.stats_multi.withColumnRenamed("true_score", "y")
    d = add_rank_pct(add_rank_pct(d, ["category"], "price", "a"), ["category"], "tax", "b")
    return rounded(L.nnls_leave_one_out(d.select("category", "item", "y", "a", "b"), ["a", "b"], "y").select("category", "item", "predicted_score"), "predicted_score")


@query("d12_ridge_meta", uses="stats_multi", oracle="""
    WITH f AS (SELECT category, item, true_score AS y, price / 1000000 AS a, tax AS b FROM stats_multi),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM f),
    l AS (SELECT category, item, a, b, n - 1 AS n, sa - a AS sa, sb - b AS sb, sy - y AS sy, aa - a * a AS aa, ab - a * b AS ab, bb - b * b AS bb, ay - a * y AS ay, by_ - b * y AS cy FROM f, s),
    c AS (SELECT *, aa - sa * sa / n + 1 AS caa, ab - sa * sb / n AS cab, bb - sb * sb / n + 1 AS cbb, ay - sa * sy / n AS cay, cy - sb * sy / n AS cby FROM l)
    SELECT category, item, round(sy / n + (cay * cbb - cby * cab) / (caa * cbb - cab * cab) * (a - sa / n) + (cby * caa - cay * cab) / (caa * cbb - cab * cab) * (b - sb / n), 6) AS predicted_score FROM c""")
def _(t):
    d = t.stats_multi.select("category", "item", F.col("true_score").alias("y"), F.array(F.col("price") / F.lit(1000000.0), F.col("tax")).alias("x"))
    return rounded(L.ridge_leave_one_out(d, "x", "y").select("category", "item", "predicted_score"), "predicted_score")


@query("d13_mean_ensemble", uses="stats_multi", oracle="""
    SELECT category, item, true_score, round((price + discount + tax) / 3, 6) AS predicted_score FROM stats_multi WHERE item % 17 <> 3""")
def _(t):
    return rounded(L.mean_ensemble(t.oof_multi, ["price", "discount", "tax"]), "predicted_score")


@query("d13_rank_ensemble", uses="stats_multi", oracle=f"""
    SELECT category, item, true_score, round(({PCT.format(c='price')} + {PCT.format(c='discount')} + {PCT.format(c='tax')}) / 3, 6) AS predicted_score
    FROM (SELECT * FROM stats_multi WHERE item % 17 <> 3)""")
def _(t):
    return rounded(L.rank_ensemble(t.oof_multi, ["price", "discount", "tax"]), "predicted_score")


@query("d14_boosted_meta")
def _(t):
    d = t.stats_multi.select("category", "item", F.col("true_score").alias("y"), F.array(F.col("price") / F.lit(1e6), F.col("tax"), F.col("discount").cast("double")).alias("x"))
    return rounded(L.boosted_trees_oof(d, "x", "y", ["category", "item"], folds=2, rounds=4, max_leaves_depth=3, early_stop=True).select("category", "item", "predicted_score"), "predicted_score")


@query("d15_random_baseline", uses="oof", oracle="""
    WITH r AS (SELECT seed, category, item, true_score, CAST('0x' || substr(md5(concat_ws(':', 'baseline', seed, category, item)), 1, 8) AS BIGINT) AS p FROM oof, range(100) s(seed))
    SELECT CAST(a.seed AS BIGINT) AS seed, round(avg(CASE WHEN a.true_score = b.true_score OR a.p = b.p THEN 0.5 WHEN (a.true_score > b.true_score) = (a.p > b.p) THEN 1.0 ELSE 0.0 END), 6) AS pairwise_accuracy
    FROM r a JOIN r b ON a.seed = b.seed AND a.category = b.category AND a.item < b.item GROUP BY 1""")
def _(t):
    return rounded(L.random_baseline(t.oof, 100).withColumn("seed", F.col("seed").cast("long")), "pairwise_accuracy")


@query("d16_best_config", uses="oof_multi", oracle=MM + "SELECT arg_max(model, macro) AS model, round(max(macro), 6) AS macro FROM mm")
def _(t):
    board = M.micro_macro(M.pairwise_accuracy(t.oof_multi, ["model", "category"]), ["model"])
    return rounded(best_by(board, [], "model", "macro"), "macro")


@query("m10_rank_in_sweep", uses="oof_multi", oracle=PC_MULTI + """,
    n AS (SELECT model, category, count(*) AS n FROM oof_multi GROUP BY 1, 2),
    s AS (SELECT t AS threshold, pc.model, sum(correct) / sum(pairs) AS micro FROM pc JOIN n ON n.model = pc.model AND n.category = pc.category, (VALUES (5), (60), (80)) v(t) WHERE n >= t GROUP BY 1, 2)
    SELECT CAST(threshold AS BIGINT) AS threshold, rank FROM (SELECT *, rank() OVER (PARTITION BY threshold ORDER BY micro DESC) AS rank FROM s) WHERE model = 'tax'""")
def _(t):
    acc = M.pairwise_accuracy(t.oof_multi, ["model", "category"])
    sweep = M.exclusion_sweep(t.oof_multi, acc, ["model"], [5, 60, 80])
    return L.sweep_rank(sweep, "tax", ["threshold"], "micro")


@query("m16_ablation_grid", uses="oof_multi", oracle="""
    WITH x AS (SELECT *, CASE WHEN item % 2 = 0 THEN 'S' ELSE 'SN' END AS subset FROM oof_multi),
    p AS (SELECT a.subset, a.model, avg(CASE WHEN abs(a.true_score - b.true_score) < 1e-10
      OR abs(a.predicted_score - b.predicted_score) < 1e-10 THEN 0.5 WHEN (a.true_score - b.true_score) * (a.predicted_score - b.predicted_score) > 0 THEN 1.0 ELSE 0.0 END) AS v
      FROM x a JOIN x b ON a.subset = b.subset AND a.model = b.model AND a.category = b.category AND a.item < b.item GROUP BY 1, 2)
    SELECT subset, round(max(CASE WHEN model = 'price' THEN v END), 6) AS price, round(max(CASE WHEN model = 'tax' THEN v END), 6) AS tax FROM p GROUP BY 1""")
def _(t):
    d = t.oof_multi.withColumn("subset", F.when(F.col("item") % 2 == 0, "S").otherwise("SN"))
    return rounded(L.ablation_grid(d, ["price", "tax"]), "price", "tax")


@query("p8_partial_least_squares")
def _(t):
    d = L.partial_least_squares(_two(t), "a", "y", 20)
    return d.select("item", F.size("pls").alias("components"), F.round(F.col("pls")[0], 6).alias("first"))


@query("p9_linear_probe")
def _(t):
    from pyspark.ml.functions import array_to_vector

    d = _two(t)
    model = L.linear_probe(d, "a", "y")
    return model.transform(d.select("item", "y", array_to_vector("a").alias("features"))).select("item", "y", "prediction")
