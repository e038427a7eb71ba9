"""Rater panel queries over the event ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.operators import metrics as M, panel as H, panel_draws as D
from prefrank.operators.conform import quantiles
from prefrank.operators.resample import bootstrap_weights, percentile_interval
from prefrank.plans.registry import query
from prefrank.session import cut_lineage

MIN = 20
R6 = lambda c: F.round(c, 6).alias(c)


def rounded(d, *cols):
    return d.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in d.columns])


# Raters of a block rated the same items; every item but the reference 0 is an analog.
BLOCKS = f"""
    WITH st AS (SELECT category, respondent, list_sort(list(item)) AS items FROM ratings GROUP BY 1, 2),
    bs AS (SELECT category, items, count(*) AS n_respondents, min(respondent) AS first FROM st GROUP BY 1, 2 HAVING count(*) >= {MIN}),
    bl AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_respondents DESC, first) - 1 AS block_id FROM bs
      WHERE len(list_filter(items, lambda i: i > 0)) >= 2),
    rt AS (SELECT bl.category, bl.block_id, r.respondent, r.item, r.similarity FROM bl JOIN st USING (category, items)
      JOIN ratings r ON r.category = st.category AND r.respondent = st.respondent WHERE r.item > 0)
"""
LOO = """, lo AS (SELECT category, respondent, item, (sum(similarity) OVER w - similarity) / (count(similarity) OVER w - 1) AS truth FROM ratings
      WINDOW w AS (PARTITION BY category, item)),
    iv AS (SELECT rt.*, truth FROM rt JOIN lo ON lo.category = rt.category AND lo.respondent = rt.respondent AND lo.item = rt.item),
    ia AS (SELECT a.category, a.block_id, a.respondent, sum(CASE WHEN abs(a.truth - b.truth) < 1e-10 OR abs(a.similarity - b.similarity) < 1e-10 THEN 0.5
      WHEN (a.truth - b.truth) * (a.similarity - b.similarity) > 0 THEN 1.0 ELSE 0.0 END) AS correct, count(*) AS n_pairs
      FROM iv a JOIN iv b ON a.category = b.category AND a.block_id = b.block_id AND a.respondent = b.respondent AND a.item < b.item GROUP BY 1, 2, 3)
"""
PAIRED = """CASE WHEN abs(a.{x} - b.{x}) < 1e-10 OR abs(a.{y} - b.{y}) < 1e-10 THEN 0.5 WHEN (a.{x} - b.{x}) * (a.{y} - b.{y}) > 0 THEN 1.0 ELSE 0.0 END"""


def _parts(t):
    r = t.ratings.select("category", "respondent", "item", "similarity")
    _, items, raters = H.blocks(r, r.filter("item > 0").select("category", "item"), MIN)
    return r, items, H.block_ratings(r, items, raters)


def _model(t):
    """A stand-in model: mean rating over even respondents predicts the mean over all."""
    return t.ratings.groupBy("category", "item").agg(
        F.avg("similarity").alias("true_score"), F.avg(F.when(F.col("respondent") % 2 == 0, F.col("similarity"))).alias("predicted_score"))


MODEL = """, mo AS (SELECT category, item, avg(similarity) AS true_score, avg(CASE WHEN respondent % 2 = 0 THEN similarity END) AS predicted_score FROM ratings GROUP BY 1, 2)"""


@query("h1_blocks", uses="ratings", oracle=BLOCKS + """
    SELECT category, block_id, n_respondents, len(items) AS n_items FROM bl""")
def _(t):
    r = t.ratings.select("category", "respondent", "item", "similarity")
    return H.blocks(r, r.filter("item > 0").select("category", "item"), MIN)[0]


@query("h1_block_items", uses="ratings", oracle=BLOCKS + """
    SELECT DISTINCT category, block_id, item FROM rt""")
def _(t):
    return _parts(t)[1]


@query("h2_panel_means", uses="ratings", oracle=BLOCKS + """
    SELECT category, block_id, item, round(avg(similarity), 6) AS mean, sum(similarity) AS sum, count(similarity) AS count FROM rt GROUP BY 1, 2, 3""")
def _(t):
    from prefrank.operators.conform import rating_stats

    return rounded(rating_stats(_parts(t)[2], ["category", "block_id", "item"]).drop("std"), "mean")


@query("h3_individual_accuracy", uses="ratings", oracle=BLOCKS + LOO + """,
    rk AS (SELECT category, block_id, respondent, rank() OVER (PARTITION BY category, block_id, respondent ORDER BY truth)
        + (count(*) OVER (PARTITION BY category, block_id, respondent, truth) - 1) / 2.0::DOUBLE AS a,
      rank() OVER (PARTITION BY category, block_id, respondent ORDER BY similarity)
        + (count(*) OVER (PARTITION BY category, block_id, respondent, similarity) - 1) / 2.0::DOUBLE AS b FROM iv),
    sp AS (SELECT category, block_id, respondent, count(*) AS n_analogs, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS spearman FROM rk GROUP BY 1, 2, 3)
    SELECT category, block_id, respondent, n_analogs, CAST(n_pairs AS DOUBLE) AS n_pairs, round(correct / n_pairs, 6) AS pairwise_accuracy,
      round(spearman, 6) AS spearman FROM ia JOIN sp USING (category, block_id, respondent)""")
def _(t):
    r, _, rated = _parts(t)
    return rounded(H.individual_accuracy(r, rated).drop("recall_at_1", "recall_at_3"), "pairwise_accuracy", "spearman")


@query("h4_group_size_curve", uses="ratings", oracle=BLOCKS + """,
    fm AS (SELECT category, item, avg(similarity) AS truth FROM ratings GROUP BY 1, 2),
    rs AS (SELECT DISTINCT category, block_id, respondent, n FROM (SELECT rt.category, rt.block_id, respondent, n_respondents AS n FROM rt JOIN bl USING (category, block_id))),
    dr AS (SELECT k, iteration, category, block_id, respondent, row_number() OVER (PARTITION BY k, iteration, category, block_id ORDER BY
        CAST('0x' || substr(md5(concat_ws(':', 9, k, iteration, respondent)), 1, 8) AS BIGINT), respondent) AS r
      FROM rs, (VALUES (1), (3), (5)) kk(k), range(10) ii(iteration) WHERE n >= k + 1),
    gm AS (SELECT k, iteration, rt.category, rt.block_id, rt.item, avg(similarity) AS pred, any_value(truth) AS truth FROM dr
      JOIN rt ON rt.category = dr.category AND rt.block_id = dr.block_id AND rt.respondent = dr.respondent
      JOIN fm ON fm.category = rt.category AND fm.item = rt.item WHERE r <= k GROUP BY 1, 2, 3, 4, 5)
    SELECT a.k, a.iteration, round(avg(""" + PAIRED.format(x="truth", y="pred") + """), 6) AS pairwise_accuracy FROM gm a JOIN gm b
      ON a.k = b.k AND a.iteration = b.iteration AND a.category = b.category AND a.block_id = b.block_id AND a.item < b.item GROUP BY 1, 2""")
def _(t):
    r, _, rated = _parts(t)
    return rounded(H.group_size_curve(r, rated, [1, 3, 5], 10, 9), "pairwise_accuracy")


ORDERED = BLOCKS + """,
    rs AS (SELECT DISTINCT category, block_id, respondent FROM rt),
    dr AS (SELECT iteration, category, block_id, respondent, count(*) OVER (PARTITION BY iteration, category, block_id) AS n,
        row_number() OVER (PARTITION BY iteration, category, block_id ORDER BY CAST('0x' || substr(md5(concat_ws(':', {seed}, iteration, respondent)), 1, 8) AS BIGINT), respondent) AS r
      FROM rs, range({iterations}) ii(iteration))"""
SPREAD = "round(quantile_cont(pairwise_accuracy, 0.5), 6) AS accuracy, round(quantile_cont(pairwise_accuracy, 0.025), 6) AS lo, round(quantile_cont(pairwise_accuracy, 0.975), 6) AS hi, count(*) AS iterations"


def _prefix_sql(iterations):
    return ORDERED.replace("{seed}", "9").replace("{iterations}", str(iterations)) + """,
    fm AS (SELECT category, item, avg(similarity) AS truth FROM ratings GROUP BY 1, 2),
    pr AS (SELECT iteration, rt.category, rt.block_id, rt.item, r AS k, n, truth, sum(sum(similarity)) OVER w / sum(count(similarity)) OVER w AS pred
      FROM dr JOIN rt ON rt.category = dr.category AND rt.block_id = dr.block_id AND rt.respondent = dr.respondent JOIN fm ON fm.category = rt.category AND fm.item = rt.item
      GROUP BY 1, 2, 3, 4, 5, 6, 7 WINDOW w AS (PARTITION BY iteration, rt.category, rt.block_id, rt.item ORDER BY r)),
    cv AS (SELECT a.k, a.iteration, avg(""" + PAIRED.format(x="truth", y="pred") + """) AS pairwise_accuracy FROM pr a JOIN pr b
      ON a.k = b.k AND a.iteration = b.iteration AND a.category = b.category AND a.block_id = b.block_id AND a.item < b.item WHERE a.k <= 75 AND a.k < a.n GROUP BY 1, 2)"""


@query("h4_curve_draws", uses="ratings", oracle=_prefix_sql(20) + "SELECT CAST(k AS INTEGER) AS k, CAST(iteration AS INTEGER) AS iteration, round(pairwise_accuracy, 6) AS pairwise_accuracy FROM cv")
def _(t):
    """Draws of the curve, an iteration's order shared by all sizes 1 to 75."""
    r, _, rated = _parts(t)
    return rounded(D.prefix_curve(r, rated, 75, 20, 9), "pairwise_accuracy")


@query("h4_full_curve", uses="ratings")
def _(t):
    """Sizes 1 to 75 at 1,000 iterations: median and interval of each."""
    r, _, rated = _parts(t)
    return rounded(D.over_iterations(D.prefix_curve(r, rated, 75, 1000, 9), ["k"]), "accuracy", "lo", "hi")


@query("h8_split_half_median", uses="ratings", oracle=ORDERED.replace("{seed}", "4").replace("{iterations}", "1000") + """,
    hm AS (SELECT iteration, rt.category, rt.block_id, item, avg(CASE WHEN r <= floor(n / 2) THEN similarity END) AS h1,
        avg(CASE WHEN r > floor(n / 2) THEN similarity END) AS h2 FROM dr
      JOIN rt ON rt.category = dr.category AND rt.block_id = dr.block_id AND rt.respondent = dr.respondent WHERE n >= 4 GROUP BY 1, 2, 3, 4),
    cv AS (SELECT a.iteration, avg(""" + PAIRED.format(x="h1", y="h2") + """) AS pairwise_accuracy FROM hm a JOIN hm b
      ON a.iteration = b.iteration AND a.category = b.category AND a.block_id = b.block_id AND a.item < b.item GROUP BY 1)
    SELECT """ + SPREAD + " FROM cv")
def _(t):
    return rounded(D.over_iterations(D.split_half_draws(_parts(t)[2], 1000, 4)), "accuracy", "lo", "hi")


CURVE = """
    WITH c AS (SELECT l_linenumber AS k, avg(l_quantity) + l_linenumber AS accuracy FROM lineitem GROUP BY 1),
    p AS (SELECT *, lag(k) OVER (ORDER BY k) AS pk, lag(accuracy) OVER (ORDER BY k) AS pa FROM c)
"""


@query("h5_interpolated_k", oracle=CURVE + """
    SELECT round(CASE WHEN pk IS NULL OR accuracy <= pa THEN k ELSE pk + (29.2 - pa) / (accuracy - pa) * (k - pk) END, 6) AS k_star
    FROM p WHERE accuracy >= 29.2 ORDER BY k LIMIT 1""")
def _(t):
    c = t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg((F.avg("l_quantity") + F.first("l_linenumber")).alias("accuracy"))
    return rounded(H.interpolated_k(c, 29.2), "k_star")


@query("h6_krippendorff_alpha", uses="ratings", oracle=BLOCKS + """,
    c AS (SELECT category, block_id, item, similarity AS v, CAST(count(*) AS DOUBLE) AS c FROM rt GROUP BY 1, 2, 3, 4),
    m AS (SELECT category, block_id, item, sum(c) AS m FROM c GROUP BY 1, 2, 3 HAVING sum(c) >= 2),
    o AS (SELECT a.category, a.block_id, a.v AS v, b.v AS u, sum(a.c * (b.c - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) / (m - 1)) AS o
      FROM c a JOIN c b USING (category, block_id, item) JOIN m USING (category, block_id, item) GROUP BY 1, 2, 3, 4),
    nc AS (SELECT category, block_id, v, sum(o) AS nc FROM o GROUP BY 1, 2, 3),
    tt AS (SELECT category, block_id, sum(nc) AS n FROM nc GROUP BY 1, 2),
    dl AS (SELECT a.category, a.block_id, a.v, b.v AS u, a.nc AS na, b.nc AS nb, pow((SELECT sum(g.nc) FROM nc g WHERE g.category = a.category
        AND g.block_id = a.block_id AND g.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v)) - (a.nc + b.nc) / 2, 2) AS d2
      FROM nc a JOIN nc b ON a.category = b.category AND a.block_id = b.block_id)
    SELECT dl.category, dl.block_id, round(1 - (sum(coalesce(o, 0) * d2) / any_value(n)) / (sum(na * nb * d2) / any_value(n * (n - 1))), 6) AS krippendorff_alpha
    FROM dl JOIN tt ON tt.category = dl.category AND tt.block_id = dl.block_id
    LEFT JOIN o ON o.category = dl.category AND o.block_id = dl.block_id AND o.v = dl.v AND o.u = dl.u GROUP BY 1, 2""")
def _(t):
    return rounded(H.krippendorff_alpha(_parts(t)[2]), "krippendorff_alpha")


@query("h7_kendall_w", uses="ratings", oracle=BLOCKS + """,
    rk AS (SELECT category, block_id, respondent, item, rank() OVER (PARTITION BY category, block_id, respondent ORDER BY similarity)
      + (count(*) OVER (PARTITION BY category, block_id, respondent, similarity) - 1) / 2.0::DOUBLE AS r FROM rt),
    s AS (SELECT category, block_id, item, sum(r) AS s, count(*) AS m FROM rk GROUP BY 1, 2, 3)
    SELECT category, block_id, round(12 * var_pop(s) * count(*) / (max(m) * max(m) * (pow(count(*), 3) - count(*))), 6) AS kendall_w FROM s GROUP BY 1, 2""")
def _(t):
    return rounded(H.kendall_w(_parts(t)[2]), "kendall_w")


@query("h8_split_half", uses="ratings", oracle=BLOCKS + """,
    rs AS (SELECT DISTINCT category, block_id, respondent FROM rt),
    dr AS (SELECT iteration, category, block_id, respondent, row_number() OVER (PARTITION BY iteration, category, block_id ORDER BY
        CAST('0x' || substr(md5(concat_ws(':', 4, iteration, respondent)), 1, 8) AS BIGINT), respondent) AS r,
        count(*) OVER (PARTITION BY iteration, category, block_id) AS n FROM rs, range(10) ii(iteration)),
    hm AS (SELECT iteration, rt.category, rt.block_id, item, avg(CASE WHEN r <= floor(n / 2) THEN similarity END) AS h1,
        avg(CASE WHEN r > floor(n / 2) THEN similarity END) AS h2 FROM dr
      JOIN rt ON rt.category = dr.category AND rt.block_id = dr.block_id AND rt.respondent = dr.respondent GROUP BY 1, 2, 3, 4)
    SELECT a.iteration, round(avg(""" + PAIRED.format(x="h1", y="h2") + """), 6) AS pairwise_accuracy FROM hm a JOIN hm b
      ON a.iteration = b.iteration AND a.category = b.category AND a.block_id = b.block_id AND a.item < b.item GROUP BY 1""")
def _(t):
    return rounded(H.split_half(_parts(t)[2], 10, 4), "pairwise_accuracy")


SIGNS = BLOCKS + """, sg AS (SELECT a.category, a.block_id, a.item AS item_1, b.item AS item_2, sum(CASE WHEN a.similarity > b.similarity THEN 1 ELSE 0 END)::BIGINT AS n_pos,
      sum(CASE WHEN a.similarity < b.similarity THEN 1 ELSE 0 END)::BIGINT AS n_neg, sum(CASE WHEN a.similarity = b.similarity THEN 1 ELSE 0 END)::BIGINT AS n_tie
      FROM rt a JOIN rt b ON a.category = b.category AND a.block_id = b.block_id AND a.respondent = b.respondent AND a.item < b.item GROUP BY 1, 2, 3, 4)"""


@query("h9_pair_signs", uses="ratings", oracle=SIGNS + "SELECT * FROM sg")
def _(t):
    return H.pair_signs(_parts(t)[2])


@query("h9_rater_agreement", uses="ratings", oracle=SIGNS + """
    SELECT category, round(sum(n_pos * (n_pos - 1) / 2 + n_neg * (n_neg - 1) / 2 + 0.5 * ((n_pos + n_neg + n_tie) * (n_pos + n_neg + n_tie - 1) / 2
      - n_pos * (n_pos - 1) / 2 - n_neg * (n_neg - 1) / 2 - n_pos * n_neg)) / sum((n_pos + n_neg + n_tie) * (n_pos + n_neg + n_tie - 1) / 2), 6) AS agreement
    FROM sg GROUP BY 1""")
def _(t):
    return rounded(H.rater_pair_agreement(H.pair_signs(_parts(t)[2]), ["category"]), "agreement")


@query("h10_pair_difficulty", uses="ratings", oracle=SIGNS + MODEL + """,
    it AS (SELECT DISTINCT rt.category, rt.item, true_score, predicted_score FROM rt JOIN mo USING (category, item)),
    pp AS (SELECT a.category, a.item AS item_1, b.item AS item_2, a.true_score - b.true_score AS gap, a.predicted_score - b.predicted_score AS pg
      FROM it a JOIN it b ON a.category = b.category AND a.item < b.item),
    s2 AS (SELECT category, item_1, item_2, sum(n_pos) AS np, sum(n_neg) AS nn, sum(n_tie) AS nt FROM sg GROUP BY 1, 2, 3),
    cr AS (SELECT abs(gap) AS d, CASE WHEN abs(gap) < 1e-10 OR abs(pg) < 1e-10 THEN 0.5 WHEN gap * pg > 0 THEN 1.0 ELSE 0.0 END AS mc,
      CASE WHEN abs(gap) < 1e-10 THEN 0.5 ELSE (CASE WHEN gap > 0 THEN np ELSE nn END + 0.5 * nt) / (np + nn + nt) END AS hc FROM pp LEFT JOIN s2 USING (category, item_1, item_2)),
    e AS (SELECT quantile_cont(d, 0.2) AS a, quantile_cont(d, 0.4) AS b, quantile_cont(d, 0.6) AS c, quantile_cont(d, 0.8) AS f FROM cr)
    SELECT CAST(CASE WHEN d <= a THEN 1 WHEN d <= b THEN 2 WHEN d <= c THEN 3 WHEN d <= f THEN 4 ELSE 5 END AS BIGINT) AS difficulty_bin,
      round(avg(hc), 6) AS human_accuracy, round(avg(mc), 6) AS model_accuracy, count(*) AS n_pairs, round(avg(d), 6) AS mean_difficulty FROM cr, e GROUP BY 1""")
def _(t):
    r, _, rated = _parts(t)
    return rounded(H.pair_difficulty(r, rated, _model(t)), "human_accuracy", "model_accuracy", "mean_difficulty")


META = {"low": ["click", "view", "error"], "high": ["signup", "purchase"]}
META_SQL = "CASE WHEN category IN ('click', 'view', 'error') THEN 'low' ELSE 'high' END"


@query("h11_meta_groups", uses="ratings", oracle=BLOCKS + LOO + MODEL + f""",
    hu AS (SELECT {META_SQL} AS meta, median(correct / n_pairs) AS human, count(DISTINCT category) AS n_categories FROM ia GROUP BY 1),
    ma AS (SELECT {META_SQL.replace("category", "a.category")} AS meta, avg({PAIRED.format(x="true_score", y="predicted_score")}) AS model FROM mo a
      JOIN mo b ON a.category = b.category AND a.item < b.item GROUP BY 1)
    SELECT meta, round(human, 6) AS human_median_accuracy, n_categories, round(model, 6) AS model_accuracy FROM hu JOIN ma USING (meta)""")
def _(t):
    r, _, rated = _parts(t)
    d = H.meta_rollup(H.individual_accuracy(r, rated), H.krippendorff_alpha(rated), M.pairwise_accuracy(_model(t), ["category"]), META)
    return rounded(d.drop("mean_alpha"), "human_median_accuracy", "model_accuracy")


WITHIN = MODEL + """,
    bi AS (SELECT DISTINCT rt.category, rt.block_id, rt.item, true_score, predicted_score FROM rt JOIN mo USING (category, item)),
    wb AS (SELECT avg(""" + PAIRED.format(x="true_score", y="predicted_score") + """) AS acc FROM bi a
      JOIN bi b ON a.category = b.category AND a.block_id = b.block_id AND a.item < b.item)"""


@query("h12_model_within_blocks", uses="ratings", oracle=BLOCKS + WITHIN + "SELECT round(acc, 6) AS pairwise_accuracy FROM wb")
def _(t):
    _, b, _ = _parts(t)
    return H.model_within_blocks(b, _model(t)).select(R6("pairwise_accuracy"))


@query("j14_block_model_scores", uses="ratings", oracle=BLOCKS + MODEL + """
    SELECT DISTINCT rt.category, rt.block_id, rt.item, round(predicted_score, 6) AS predicted_score FROM rt JOIN mo USING (category, item)""")
def _(t):
    _, b, _ = _parts(t)
    d = b.join(_model(t), ["category", "item"])
    return d.select("category", "block_id", "item", R6("predicted_score"))


@query("h13_share_exceeded", uses="ratings", oracle=BLOCKS + LOO + """
    SELECT round(avg(CASE WHEN correct / n_pairs < 0.55 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent_exceeded FROM ia""")
def _(t):
    r, _, rated = _parts(t)
    return rounded(H.share_exceeded(H.individual_accuracy(r, rated), 0.55), "percent_exceeded")


@query("h14_comparison_table", uses="ratings", oracle=BLOCKS + LOO + WITHIN + """
    SELECT 'individual' AS source, round(median(correct / n_pairs), 6) AS accuracy FROM ia UNION ALL SELECT 'model', round(acc, 6) FROM wb""")
def _(t):
    r, b, rated = _parts(t)
    ind = quantiles(H.individual_accuracy(r, rated).withColumn("_all", F.lit(1)), ["_all"], "pairwise_accuracy", [0.5])
    model = H.model_within_blocks(b, _model(t)).select(F.col("pairwise_accuracy").alias("accuracy"))
    return rounded(H.comparison_table({"individual": ind.select(F.col("q")[0].alias("accuracy")), "model": model}), "accuracy")


@query("m14_category_comparison", uses="ratings", oracle=BLOCKS + LOO + MODEL + f""",
    ma AS (SELECT a.category, avg({PAIRED.format(x="true_score", y="predicted_score")}) AS model FROM mo a JOIN mo b ON a.category = b.category AND a.item < b.item GROUP BY 1)
    SELECT category, round(median(correct / n_pairs), 6) AS human_median, round(any_value(model), 6) AS model_accuracy FROM ia JOIN ma USING (category) GROUP BY 1""")
def _(t):
    r, _, rated = _parts(t)
    h = quantiles(H.individual_accuracy(r, rated), ["category"], "pairwise_accuracy", [0.5]).select("category", F.col("q")[0].alias("human_median"))
    m = M.pairwise_accuracy(_model(t), ["category"]).select("category", F.col("pairwise_accuracy").alias("model_accuracy"))
    return rounded(h.join(m, "category"), "human_median", "model_accuracy")


@query("h15_release_table", uses="ratings", oracle=BLOCKS + "SELECT category, block_id, item, similarity FROM rt ORDER BY ALL")
def _(t):
    return H.release_table(_parts(t)[2], ["category", "block_id", "item", "similarity"])


@query("b12_k_star_interval")
def _(t):
    """Interval of k* when the iterations of the group-size curve are resampled."""
    r, _, rated = _parts(t)
    curve = cut_lineage(H.group_size_curve(r, rated, [1, 3, 5, 9], 50, 9))  # resampled, and read for its iterations
    w = bootstrap_weights(curve.select("iteration").distinct(), [], "iteration", 200, 13)
    d = curve.join(F.broadcast(w), "iteration").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    med = quantiles(d, ["rep", "k"], "pairwise_accuracy", [0.5]).select("rep", "k", F.col("q")[0].alias("accuracy"))
    stars = H.interpolated_k(med, 0.55, ["rep"]).select(F.lit(1).alias("_all"), F.col("k_star").alias("value"))
    return rounded(percentile_interval(stars, ["_all"]).drop("_all"), "lo", "hi")
