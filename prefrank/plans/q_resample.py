"""Classification, bootstrap, jackknife and test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.operators import classify as C, metrics as M, resample as B
from prefrank.plans.q_metrics import PC_MULTI, PC_OOF
from prefrank.plans.registry import query

P5 = ["p0", "p1", "p2", "p3", "p4"]
LEVELS = [0, 1, 2, 3, 4]
R6 = lambda c: F.round(c, 6).alias(c)


def rounded(d, *cols):
    return d.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in d.columns])


PRED = """
    WITH pr AS (SELECT *, CASE WHEN p0 >= greatest(p1, p2, p3, p4) THEN 0 WHEN p1 >= greatest(p2, p3, p4) THEN 1
      WHEN p2 >= greatest(p3, p4) THEN 2 WHEN p3 >= p4 THEN 3 ELSE 4 END AS y_pred, greatest(p0, p1, p2, p3, p4) AS conf FROM probs),
    lv AS (SELECT l FROM (VALUES (0), (1), (2), (3), (4)) v(l)),
    cs AS (SELECT CAST(l AS BIGINT) AS label, sum(CASE WHEN y_true = l AND y_pred = l THEN 1 ELSE 0 END) AS tp,
      sum(CASE WHEN y_true = l THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN y_pred = l THEN 1 ELSE 0 END) AS pp FROM pr, lv GROUP BY 1),
    sc AS (SELECT label, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS precision, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS recall,
      CASE WHEN pp + sup = 0 THEN 0 ELSE 2 * tp / (pp + sup) END AS f1, CAST(sup AS BIGINT) AS support FROM cs)
"""


@query("c1_label_codes", oracle="""
    SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END::BIGINT AS code, lang AS back FROM documents""")
def _(t):
    order = ["en", "fr", "de", "es"]
    d = t.documents.select("doc_id", C.encoded(F.col("lang"), order).alias("code"))
    return d.withColumn("back", C.decoded(F.col("code"), order))


@query("c2_argmax", uses="probs", oracle=PRED + "SELECT id, CAST(y_pred AS BIGINT) AS y_pred FROM pr")
def _(t):
    return t.probs.select("id", C.argmax([F.col(c) for c in P5]).alias("y_pred"))


@query("c3_confusion", uses="probs", oracle=PRED + """
    SELECT CAST(a.l AS BIGINT) AS y_true, CAST(b.l AS BIGINT) AS y_pred, count(id) AS n FROM lv a CROSS JOIN lv b
    LEFT JOIN pr ON y_true = a.l AND y_pred = b.l GROUP BY 1, 2""")
def _(t):
    return C.confusion(t.probs, P5, LEVELS)


@query("c4_class_scores", uses="probs", oracle=PRED + """
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM sc""")
def _(t):
    return rounded(C.class_scores(C.confusion(t.probs, P5, LEVELS), LEVELS).drop("tp"), "precision", "recall", "f1")


@query("c4_macro_scores", uses="probs", oracle=PRED + """
    SELECT (SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) FROM pr) AS accuracy, round(avg(precision), 6) AS precision,
      round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM sc""")
def _(t):
    d = C.macro_scores(C.class_scores(C.confusion(t.probs, P5, LEVELS), LEVELS))
    return rounded(d, *d.columns)


LONGP = """lp AS (SELECT id, y_true = l AS hit, CAST(l AS BIGINT) AS label, CASE l WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END AS p
    FROM probs, (VALUES (0), (1), (2), (3), (4)) v(l))"""


@query("c5_auroc", uses="probs", oracle="WITH " + LONGP + """,
    r AS (SELECT label, hit, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0::DOUBLE AS r FROM lp),
    s AS (SELECT label, sum(CASE WHEN hit THEN r END) AS sr, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS DOUBLE) AS np, count(*) AS n FROM r GROUP BY 1)
    SELECT label, round((sr - np * (np + 1) / 2) / (np * (n - np)), 6) AS auroc FROM s""")
def _(t):
    return rounded(C.one_vs_rest_auc(t.probs, P5), "auroc")


BINS = PRED + """, bn AS (SELECT CAST(ceil(conf * 10) AS BIGINT) AS bin, count(*) AS n, avg(conf) AS confidence,
    avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pr GROUP BY 1)"""


@query("c6_calibration_error", uses="probs", oracle=BINS + """
    SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM bn""")
def _(t):
    return rounded(C.expected_calibration_error(t.probs, P5), "ece")


@query("c7_reliability_curve", uses="probs", oracle=BINS + """
    SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bn""")
def _(t):
    return rounded(C.calibration_bins(t.probs, P5), "confidence", "accuracy")


@query("c7_roc_points", uses="probs", oracle="WITH " + LONGP + """,
    c AS (SELECT DISTINCT label, p, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w AS fp,
      sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY label) AS np, count(*) OVER (PARTITION BY label) AS n FROM lp
      WINDOW w AS (PARTITION BY label ORDER BY p DESC))
    SELECT label, round(p, 9) AS threshold, round(tp / np, 6) AS tpr, round(fp / (n - np), 6) AS fpr FROM c""")
def _(t):
    d = C.roc_points(t.probs, P5)
    return d.select("label", F.round("threshold", 9).alias("threshold"), R6("tpr"), R6("fpr"))


@query("c8_competition_macro_f1", oracle="""
    WITH s AS (SELECT lang AS truth, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS answer FROM documents),
    c AS (SELECT l, sum(CASE WHEN truth = l AND answer = l THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN truth = l THEN 1 ELSE 0 END) AS n,
      sum(CASE WHEN answer = l THEN 1 ELSE 0 END) AS m FROM s, (VALUES ('en'), ('fr'), ('de'), ('es')) v(l) GROUP BY 1)
    SELECT round(avg(2 * tp / (n + m)), 6) AS macro_f1 FROM c""")
def _(t):
    ans = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("answer"))
    sol = t.documents.select("doc_id", F.col("lang").alias("truth"))
    return rounded(C.competition_macro_f1(ans, sol, "doc_id", {"en": 0, "fr": 1, "de": 2, "es": 3}), "macro_f1")


@query("c9_reordered_columns", uses="probs", oracle="""
    SELECT id, round(p2, 6) AS prob_a, round(p0, 6) AS prob_b, round(p1, 6) AS prob_c FROM probs""")
def _(t):
    d = t.probs.select("id", *C.reordered(["p0", "p1", "p2"], ["b", "c", "a"], ["a", "b", "c"]))
    return rounded(d, "prob_a", "prob_b", "prob_c")


DRAW = """
    ix AS (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY item) - 1 AS pos, count(*) OVER (PARTITION BY category) AS n FROM {t}),
    dr AS (SELECT rep, category, CAST('0x' || substr(md5(concat_ws(':', {seed}, rep // 2, category, pos)), 1 + 16 * (rep % 2), 15) AS BIGINT) % n AS pos
      FROM ix, range({reps}) r(rep)),
    bw AS (SELECT dr.rep, dr.category, ix.item, count(*) AS w FROM dr JOIN ix ON ix.category = dr.category AND ix.pos = dr.pos GROUP BY 1, 2, 3)
"""
CREDIT = """CASE WHEN abs(a.true_score - b.true_score) < 1e-10 OR abs(a.predicted_score - b.predicted_score) < 1e-10 THEN 0.5
    WHEN (a.true_score - b.true_score) * (a.predicted_score - b.predicted_score) > 0 THEN 1.0 ELSE 0.0 END"""
#: Draws of accuracy resamples, and of the intervals and classifier resamples.
REPS, MORE_REPS = 5000, 10_000
BOOT = "WITH " + DRAW.format(t="oof", seed=7, reps=REPS) + f""",
    ws AS (SELECT rep, category, item, w, true_score, predicted_score FROM bw JOIN oof USING (category, item)),
    cross_pairs AS (SELECT a.rep, a.category, sum(a.w * b.w * {CREDIT}) AS c, sum(a.w * b.w) AS p
      FROM ws a JOIN ws b ON a.rep = b.rep AND a.category = b.category AND a.item < b.item GROUP BY 1, 2),
    own AS (SELECT rep, category, sum(w * (w - 1) / 2) AS p FROM bw GROUP BY 1, 2),
    bc AS (SELECT o.rep, o.category, coalesce(x.c, 0) + o.p / 2 AS correct, coalesce(x.p, 0) + o.p AS pairs FROM own o
      LEFT JOIN cross_pairs x ON x.rep = o.rep AND x.category = o.category),
    bv AS (SELECT rep, sum(correct) / sum(pairs) AS value FROM bc GROUP BY 1)
"""


@query("b1_stratified_draws", uses="oof", oracle="WITH " + DRAW.format(t="oof", seed=7, reps=200) + """
    SELECT CAST(rep AS BIGINT) AS rep, category, item, w FROM bw""")
def _(t):
    return B.bootstrap_weights(t.oof, ["category"], "item", 200, 7).withColumn("rep", F.col("rep").cast("long"))


def _boot(t, **kw):
    return B.bootstrap_accuracy(t.oof, REPS, 7, [], **kw)


@query("b2_bootstrap_accuracy", uses="oof", oracle=BOOT + "SELECT CAST(rep AS BIGINT) AS rep, round(value, 6) AS value FROM bv")
def _(t):
    return _boot(t).select(F.col("rep").cast("long").alias("rep"), R6("value"))


@query("b3_jackknife_accuracy", uses="oof_multi", oracle=f"""
    WITH ic AS (SELECT a.model, a.category, a.item, sum({CREDIT}) AS c, count(*) AS m FROM oof_multi a
      JOIN oof_multi b ON a.model = b.model AND a.category = b.category AND a.item <> b.item GROUP BY 1, 2, 3),
    tt AS (SELECT model, sum(c) / 2 AS tc, sum(m) / 2 AS tp FROM ic GROUP BY 1)
    SELECT model, category, item, round((tc - c) / (tp - m), 8) AS value FROM ic JOIN tt USING (model)""")
def _(t):
    return B.jackknife_accuracy(t.oof_multi).select("model", "category", "item", F.round("value", 8).alias("value"))


@query("b7_percentile_interval", uses="oof", oracle=BOOT + """
    SELECT round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM bv""")
def _(t):
    return B.percentile_interval(_boot(t).withColumn("_all", F.lit(1)), ["_all"]).select(R6("lo"), R6("hi"))


def _bca(t, variant, seed=7, reps=MORE_REPS):
    key = ["metric"]
    tag = lambda d: d.withColumn("metric", F.lit("pairwise_accuracy"))
    obs = tag(M.micro_macro(M.pairwise_accuracy(t.oof, ["category"]), []).select(F.col("micro").alias("value")))
    d = B.bca_interval(obs, tag(B.bootstrap_accuracy(t.oof, reps, seed, [])), tag(B.jackknife_accuracy(t.oof, [])), key, variant)
    return rounded(d, "point", "lo", "hi")


@query("b4_bca_strict")
def _(t):
    return _bca(t, "strict")


@query("b5_bca_midp")
def _(t):
    return _bca(t, "midp")


@query("b6_bca_filtered")
def _(t):
    return _bca(t, "filtered")


@query("b8_cluster_bootstrap", uses="oof", oracle=PC_OOF + """,
    ix AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS pos, count(*) OVER () AS n, correct, pairs FROM pc),
    dr AS (SELECT rep, CAST('0x' || substr(md5(concat_ws(':', 11, rep // 2, pos)), 1 + 16 * (rep % 2), 15) AS BIGINT) % n AS pos FROM ix, range(5000) r(rep))
    SELECT CAST(rep AS BIGINT) AS rep, round(sum(correct) / sum(pairs), 6) AS value FROM dr JOIN ix USING (pos) GROUP BY 1""")
def _(t):
    blocks = M.pairwise_accuracy(t.oof, ["category"])
    return B.cluster_bootstrap(blocks, "category", REPS, 11).select(F.col("rep").cast("long").alias("rep"), R6("value"))


@query("b8_cluster_jackknife", uses="oof", oracle=PC_OOF + """
    SELECT category, round(((SELECT sum(correct) FROM pc) - correct) / ((SELECT sum(pairs) FROM pc) - pairs), 6) AS value FROM pc""")
def _(t):
    return rounded(B.cluster_jackknife(M.pairwise_accuracy(t.oof, ["category"]), "category"), "value")


ROWDRAW = """
    WITH ix AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM probs),
    dr AS (SELECT CAST(rep AS BIGINT) AS rep, CAST('0x' || substr(md5(concat_ws(':', 5, rep // 2, pos)), 1 + 16 * (rep % 2), 15) AS BIGINT) % n AS pos FROM ix, range(10000) r(rep)),
    bs AS (SELECT rep, y_true, p0, p1, p2, p3, p4, CASE WHEN p0 >= greatest(p1, p2, p3, p4) THEN 0 WHEN p1 >= greatest(p2, p3, p4) THEN 1
      WHEN p2 >= greatest(p3, p4) THEN 2 WHEN p3 >= p4 THEN 3 ELSE 4 END AS y_pred FROM dr JOIN ix USING (pos)),
    cs AS (SELECT rep, CAST(l AS BIGINT) AS label, sum(CASE WHEN y_true = l AND y_pred = l THEN 1 ELSE 0 END) AS tp,
      sum(CASE WHEN y_true = l THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN y_pred = l THEN 1 ELSE 0 END) AS pp
      FROM bs, (VALUES (0), (1), (2), (3), (4)) v(l) GROUP BY 1, 2),
    sc AS (SELECT rep, label, tp, sup, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS precision, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS recall,
      CASE WHEN pp + sup = 0 THEN 0 ELSE 2 * tp / (pp + sup) END AS f1 FROM cs),
    lp AS (SELECT rep, CAST(l AS BIGINT) AS label, y_true = l AS hit, CASE l WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END AS p
      FROM bs, (VALUES (0), (1), (2), (3), (4)) v(l)),
    rk AS (SELECT rep, label, hit, rank() OVER (PARTITION BY rep, label ORDER BY p) + (count(*) OVER (PARTITION BY rep, label, p) - 1) / 2.0::DOUBLE AS r FROM lp),
    au AS (SELECT rep, label, (sum(CASE WHEN hit THEN r END) - sum(CASE WHEN hit THEN 1 ELSE 0 END) * (sum(CASE WHEN hit THEN 1 ELSE 0 END) + 1) / 2)
      / nullif(sum(CASE WHEN hit THEN 1 ELSE 0 END) * sum(CASE WHEN hit THEN 0 ELSE 1 END), 0) AS auroc FROM rk GROUP BY 1, 2)
"""


@query("b9_bootstrap_classifier", uses="probs", oracle=ROWDRAW + """
    SELECT rep, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
      round(avg(f1), 6) AS f1, round(avg(auroc), 6) AS auroc FROM sc JOIN au USING (rep, label) GROUP BY 1""")
def _(t):
    d = B.bootstrap_classifier(t.probs, "id", LEVELS, P5, MORE_REPS, 5)
    return d.select(F.col("rep").cast("long").alias("rep"), *[R6(c) for c in ("accuracy", "precision", "recall", "f1", "auroc")])


@query("b10_bootstrap_per_class", uses="probs", oracle=ROWDRAW + """
    SELECT rep, label, CASE WHEN sup > 0 THEN round(precision, 6) END AS precision, CASE WHEN sup > 0 THEN round(recall, 6) END AS recall,
      CASE WHEN sup > 0 THEN round(f1, 6) END AS f1, round(auroc, 6) AS auroc FROM sc JOIN au USING (rep, label)""")
def _(t):
    d = B.bootstrap_classifier(t.probs, "id", LEVELS, P5, MORE_REPS, 5, per_class=True)
    return d.select(F.col("rep").cast("long").alias("rep"), "label", *[R6(c) for c in ("precision", "recall", "f1", "auroc")])


@query("b11_category_interval", uses="oof", oracle=BOOT + """
    SELECT category, round(quantile_cont(correct / pairs, 0.025), 6) AS lo, round(quantile_cont(correct / pairs, 0.975), 6) AS hi FROM bc GROUP BY 1""")
def _(t):
    return rounded(B.percentile_interval(_boot(t, per_stratum=True), ["category"]), "lo", "hi")


MEDIAN = """
    WITH ix AS (SELECT item, predicted_score, row_number() OVER (ORDER BY item) - 1 AS pos, count(*) OVER () AS n FROM oof),
    dr AS (SELECT CAST(rep AS BIGINT) AS rep, CAST('0x' || substr(md5(concat_ws(':', 3, rep // 2, pos)), 1 + 16 * (rep % 2), 15) AS BIGINT) % n AS pos FROM ix, range(10000) r(rep)),
    md AS (SELECT rep, median(predicted_score) AS value FROM dr JOIN ix USING (pos) GROUP BY 1)
"""


@query("b12_bootstrap_median", uses="oof", oracle=MEDIAN + "SELECT rep, round(value, 4) AS value FROM md")
def _(t):
    return B.bootstrap_median(t.oof, "item", "predicted_score", MORE_REPS, 3).select(
        F.col("rep").cast("long").alias("rep"), F.round("value", 4).alias("value"))


@query("b12_one_sided_p", uses="oof", oracle=MEDIAN + """
    SELECT round(avg(CASE WHEN value >= (SELECT median(predicted_score) FROM oof) THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM md""")
def _(t):
    from prefrank.operators.conform import quantiles

    boot = B.bootstrap_median(t.oof, "item", "predicted_score", MORE_REPS, 3)
    target = quantiles(t.oof.withColumn("_all", F.lit(1)), ["_all"], "predicted_score", [0.5]).select(F.col("q")[0].alias("target"))
    return rounded(B.one_sided_p(boot.crossJoin(F.broadcast(target)), F.col("target")), "p_value")


@query("b18_order_invariance", uses="oof", oracle=f"""
    SELECT 'bootstrap_accuracy' AS statistic, CAST({REPS} AS BIGINT) AS compared, CAST(0 AS BIGINT) AS differing
    UNION ALL SELECT 'category_metrics', count(DISTINCT category), 0 FROM oof""")
def _(t):
    other = B.rearranged(t.oof, 13, "item")
    metrics = ["pairwise_accuracy", "recall_at_1", "recall_at_3"]
    checks = [("bootstrap_accuracy", B.differing_rows(_boot(t), B.bootstrap_accuracy(other, REPS, 7, []), ["rep"], ["value"])),
              ("category_metrics", B.differing_rows(M.category_metrics(t.oof), M.category_metrics(other), ["category"], metrics))]
    out = [d.select(F.lit(name).alias("statistic"), "compared", "differing") for name, d in checks]
    return out[0].unionByName(out[1])


@query("b13_mcnemar", oracle="""
    WITH k AS (SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b,
      CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM labels)
    SELECT b, c, b + c AS n_discordant, CASE WHEN b + c = 0 THEN 0 ELSE round((abs(b - c) - 1) * (abs(b - c) - 1) / (b + c), 6) END AS chi2 FROM k""")
def _(t):
    d = t.labels.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return rounded(B.mcnemar(d, with_p=False), "chi2")


@query("b13_mcnemar_p")
def _(t):
    d = t.labels.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return rounded(B.mcnemar(d), "chi2", "p_value")


SUMMARY = """
    WITH g AS (SELECT event_type AS unit, user_id % 7 AS grp, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1, 2),
    u AS (SELECT unit, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1)
"""


def _summaries(t):
    return t.events.groupBy(F.col("event_type").alias("unit"), (F.col("user_id") % 7).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


@query("b14_anova", oracle=SUMMARY + """
    SELECT g.unit, CAST(count(*) - 1 AS DOUBLE) AS df_between, sum(n) - count(*) AS df_within, round(max(m) - min(m), 6) AS mean_range,
      round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * sd * sd) / (sum(n) - count(*))), 6) AS f
    FROM g JOIN u ON u.unit = g.unit GROUP BY 1""")
def _(t):
    return rounded(B.anova_from_summaries(_summaries(t), "unit", with_p=False), "f", "mean_range").select(
        "unit", "df_between", "df_within", "mean_range", "f")


@query("b14_anova_p")
def _(t):
    return rounded(B.anova_from_summaries(_summaries(t), "unit"), "f", "mean_range", "p_value")


@query("b15_benjamini_hochberg", oracle="""
    WITH p AS (SELECT l_partkey, 1 - avg(l_quantity) / 50 AS p FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)
    SELECT l_partkey, p <= (SELECT max(p) FROM r WHERE p <= i / m * 0.7::DOUBLE) AS significant FROM p""")
def _(t):
    p = t.lineitem.groupBy("l_partkey").agg((F.lit(1.0) - F.avg("l_quantity") / 50).alias("p"))
    return B.benjamini_hochberg(p, "p", 0.7).select("l_partkey", "significant")


@query("c10_paired_gap", uses="probs", oracle=ROWDRAW.split("lp AS")[0].rstrip().rstrip(",") + """
    SELECT CAST(rep AS BIGINT) AS rep, round(avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END)
      - avg(CASE WHEN y_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy_gap FROM bs GROUP BY 1""")
def _(t):
    d = t.probs.select("id", "y_true", C.argmax([F.col(c) for c in P5]).alias("a"))
    hit = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    gap = B.bootstrap_means(d, "id", {"gap": hit(F.col("a") == F.col("y_true")) - hit(F.col("y_true") == 0)}, MORE_REPS, 5)
    return gap.select(F.col("rep").cast("long").alias("rep"), F.round("gap", 6).alias("accuracy_gap"))


@query("m12_leaderboard_overlap", uses="oof_multi", oracle=PC_MULTI + """,
    ci AS (SELECT model, avg(correct / pairs) AS point, quantile_cont(correct / pairs, 0.25) AS lo, quantile_cont(correct / pairs, 0.75) AS hi FROM pc GROUP BY 1),
    ld AS (SELECT model AS leader, lo AS l, hi AS h FROM ci ORDER BY point DESC, model LIMIT 1)
    SELECT model, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, leader, model = leader AS is_leader,
      greatest(lo, l) <= least(hi, h) AND model <> leader AS overlaps FROM ci, ld""")
def _(t):
    from prefrank.operators.conform import quantiles

    acc = M.pairwise_accuracy(t.oof_multi, ["model", "category"])
    q = quantiles(acc, ["model"], "pairwise_accuracy", [.25, .75]).select("model", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    ci = acc.groupBy("model").agg(F.avg("pairwise_accuracy").alias("point")).join(q, "model").withColumn("board", F.lit(1))
    return rounded(M.leaderboard_overlap(ci, ["board"]).drop("board"), "point", "lo", "hi")
