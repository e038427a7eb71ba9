"""Ranking metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.operators import metrics as M
from prefrank.plans.registry import query

R6 = lambda c: F.round(c, 6).alias(c)

PAIR_CREDIT = """
    WITH pc AS (
      SELECT {k}, sum(CASE WHEN abs(a.true_score - b.true_score) < 1e-10 THEN 0.5
                       WHEN abs(a.predicted_score - b.predicted_score) < 1e-10 THEN 0.5
                       WHEN (a.true_score - b.true_score) * (a.predicted_score - b.predicted_score) > 0 THEN 1.0
                       ELSE 0.0 END) AS correct, CAST(count(*) AS DOUBLE) AS pairs
      FROM {t} a JOIN {t} b ON {on} AND a.item < b.item GROUP BY {k})
"""
PC_OOF = PAIR_CREDIT.format(k="a.category", t="oof", on="a.category = b.category")
PC_MULTI = PAIR_CREDIT.format(k="a.model, a.category", t="oof_multi",
                              on="a.model = b.model AND a.category = b.category")

AVG_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"
SPEARMAN = """rk AS (SELECT {k}, """ + AVG_RANK.replace("{c}", "true_score") + """ AS ra, """ + \
    AVG_RANK.replace("{c}", "predicted_score") + """ AS rb FROM {t}
    WHERE true_score IS NOT NULL AND predicted_score IS NOT NULL),
    sp AS (SELECT {k}, corr(ra, rb) AS spearman FROM rk GROUP BY {k})"""
KENDALL = """kd AS (SELECT {ka}, sum(sign(a.true_score - b.true_score) * sign(a.predicted_score - b.predicted_score))
      AS s, sum(CASE WHEN a.true_score <> b.true_score THEN 1 ELSE 0 END) AS nx,
      sum(CASE WHEN a.predicted_score <> b.predicted_score THEN 1 ELSE 0 END) AS ny
    FROM {t} a JOIN {t} b ON {on} AND a.item < b.item GROUP BY {ka}),
    kt AS (SELECT {k}, s / sqrt(CAST(nx AS DOUBLE) * CAST(ny AS DOUBLE)) AS kendall_tau FROM kd)"""
RECALL = """best AS (SELECT {k}, arg_max(predicted_score, (true_score, -predicted_score)) AS bp FROM {t} GROUP BY {k}),
    ab AS (SELECT {ko}, sum(CASE WHEN predicted_score > bp + 1e-10 THEN 1 ELSE 0 END) AS above,
           sum(CASE WHEN abs(predicted_score - bp) < 1e-10 THEN 1 ELSE 0 END) AS tied
           FROM {t} o JOIN best ON {onb} GROUP BY {ko}),
    rc AS (SELECT {k}, CASE WHEN above >= 1 THEN 0.0 ELSE least(1 - above, tied) / tied END AS recall_at_1,
           CASE WHEN above >= 2 THEN 0.0 ELSE least(2 - above, tied) / tied END AS recall_at_2,
           CASE WHEN above >= 3 THEN 0.0 ELSE least(3 - above, tied) / tied END AS recall_at_3 FROM ab)"""
SP_OOF = SPEARMAN.format(k="category", t="oof")
KT_OOF = KENDALL.format(k="category", ka="a.category", t="oof", on="a.category = b.category")
RC_OOF = RECALL.format(k="category", ko="o.category", t="oof", onb="o.category = best.category")


@query("m1_pairwise_accuracy", uses="oof_multi", oracle=PC_MULTI + """
    SELECT model, category, correct, pairs, round(correct / pairs, 6) AS pairwise_accuracy FROM pc""")
def _(t):
    return M.pairwise_accuracy(t.oof_multi, ["model", "category"]).withColumn("pairwise_accuracy", R6("pairwise_accuracy"))


@query("m2_spearman", uses="oof_multi", oracle="WITH " + SPEARMAN.format(k="model, category", t="oof_multi") + """
    SELECT model, category, round(spearman, 6) AS spearman FROM sp""")
def _(t):
    return M.spearman(t.oof_multi, ["model", "category"]).withColumn("spearman", R6("spearman"))


@query("m3_kendall_tau_b", uses="oof", oracle="WITH " + KT_OOF + """
    SELECT category, round(kendall_tau, 6) AS kendall_tau FROM kt""")
def _(t):
    return M.kendall_tau(t.oof, ["category"]).withColumn("kendall_tau", R6("kendall_tau"))


@query("m4_recall_at_k", uses="oof", oracle="WITH " + RC_OOF + """
    SELECT category, round(recall_at_1, 6) AS recall_at_1, round(recall_at_2, 6) AS recall_at_2,
           round(recall_at_3, 6) AS recall_at_3 FROM rc""")
def _(t):
    return M.recall_at(t.oof, ["category"]).select("category", *[R6(f"recall_at_{k}") for k in (1, 2, 3)])


CATEGORY_METRICS = PC_OOF + ", " + SP_OOF + ", " + KT_OOF + ", " + RC_OOF + """,
    cm AS (SELECT pc.category, n_products, spearman, kendall_tau, correct AS correct_pairs, pairs AS total_pairs,
           correct / pairs AS pairwise_accuracy, recall_at_1, recall_at_2, recall_at_3
    FROM pc JOIN (SELECT category, count(*) AS n_products FROM oof GROUP BY 1) n ON n.category = pc.category
    JOIN sp ON sp.category = pc.category JOIN kt ON kt.category = pc.category JOIN rc ON rc.category = pc.category)"""


@query("m5_category_metrics", uses="oof", oracle=CATEGORY_METRICS + """
    SELECT category, n_products, correct_pairs, total_pairs, round(spearman, 6) AS spearman,
           round(kendall_tau, 6) AS kendall_tau, round(pairwise_accuracy, 6) AS pairwise_accuracy,
           round(recall_at_1, 6) AS recall_at_1, round(recall_at_2, 6) AS recall_at_2,
           round(recall_at_3, 6) AS recall_at_3 FROM cm""")
def _(t):
    m = M.category_metrics(t.oof)
    rounded = ["spearman", "kendall_tau", "pairwise_accuracy", "recall_at_1", "recall_at_2", "recall_at_3"]
    return m.select("category", "n_products", "correct_pairs", "total_pairs", *[R6(c) for c in rounded])


@query("m5_overall_metrics", uses="oof", oracle=CATEGORY_METRICS + """
    SELECT round(sum(spearman * n_products) / sum(n_products), 6) AS spearman,
           round(sum(kendall_tau * n_products) / sum(n_products), 6) AS kendall_tau,
           round(sum(correct_pairs) / sum(total_pairs), 6) AS pairwise_accuracy,
           round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_2), 6) AS recall_at_2,
           round(avg(recall_at_3), 6) AS recall_at_3 FROM cm""")
def _(t):
    m = M.overall_metrics(M.category_metrics(t.oof))
    return m.select(*[R6(c) for c in m.columns])


MM = PC_MULTI + """, mm AS (SELECT model, sum(correct) / sum(pairs) AS micro, avg(correct / pairs) AS macro
    FROM pc GROUP BY model)"""


@query("m6_macro_accuracy", uses="oof_multi", oracle=MM + """
    SELECT model, round(micro, 6) AS micro, round(macro, 6) AS macro, round(macro - micro, 6) AS delta FROM mm""")
def _(t):
    acc = M.pairwise_accuracy(t.oof_multi, ["model", "category"])
    return M.micro_macro(acc, ["model"]).select("model", R6("micro"), R6("macro"), R6("delta"))


@query("m7_partial_pooling", uses="oof_multi", oracle=PC_MULTI + """,
    c AS (SELECT model, correct / pairs AS p, pairs AS n,
          greatest(least(correct / pairs, 1 - 0.5 / pairs), 0.5 / pairs) AS pt FROM pc),
    v AS (SELECT model, p, pt * (1 - pt) / n AS v FROM c),
    q AS (SELECT model, count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sww,
          sum(p / v) / sum(1 / v) AS fm FROM v GROUP BY model),
    q2 AS (SELECT v.model, sum((p - fm) * (p - fm) / v) AS qq FROM v JOIN q ON q.model = v.model GROUP BY v.model),
    tau AS (SELECT q.model, greatest(0.0, (qq - (k - 1)) / (sw - sww / sw)) AS tau2 FROM q JOIN q2 ON q.model = q2.model),
    re AS (SELECT v.model, any_value(tau2) AS tau2, sum(p / (v + tau2)) / sum(1 / (v + tau2)) AS re_mean
          FROM v JOIN tau ON tau.model = v.model GROUP BY v.model)
    SELECT v.model, round(any_value(tau2), 6) AS tau2, round(any_value(re_mean), 6) AS re_mean,
           round(avg((tau2 * p + v * re_mean) / (tau2 + v)), 6) AS partial_pooled
    FROM v JOIN re ON re.model = v.model GROUP BY v.model""")
def _(t):
    acc = M.pairwise_accuracy(t.oof_multi, ["model", "category"])
    d = M.partial_pooled(acc, ["model"])
    return d.select("model", R6("tau2"), R6("re_mean"), R6("partial_pooled"))


@query("m8_exclusion_sweep", uses="oof_multi", oracle=PC_MULTI + """,
    n AS (SELECT model, category, count(*) AS n FROM oof_multi GROUP BY 1, 2),
    s AS (SELECT pc.model, t AS threshold, correct, pairs FROM pc
          JOIN n ON n.model = pc.model AND n.category = pc.category, (VALUES (5), (60), (80), (90)) v(t) WHERE n >= t)
    SELECT model, CAST(threshold AS BIGINT) AS threshold, round(sum(correct) / sum(pairs), 6) AS micro,
           round(avg(correct / pairs), 6) AS macro,
           round(avg(correct / pairs) - sum(correct) / sum(pairs), 6) AS delta FROM s GROUP BY 1, 2""")
def _(t):
    acc = M.pairwise_accuracy(t.oof_multi, ["model", "category"])
    d = M.exclusion_sweep(t.oof_multi, acc, ["model"], [5, 60, 80, 90])
    return d.select("model", "threshold", R6("micro"), R6("macro"), R6("delta"))


@query("m9_scheme_rank_correlation", uses="oof_multi", oracle=MM + """,
    r AS (SELECT rank() OVER (ORDER BY micro) AS a, rank() OVER (ORDER BY macro) AS b FROM mm)
    SELECT round(corr(a, b), 6) AS spearman FROM r""")
def _(t):
    board = M.micro_macro(M.pairwise_accuracy(t.oof_multi, ["model", "category"]), ["model"])
    return M.scheme_correlation(board, "micro", "macro").select(R6("spearman"))


@query("m11_strict_tie_accuracy", uses="oof", oracle="""
    SELECT a.category, CAST(sum(CASE WHEN a.predicted_score = b.predicted_score THEN 0.5
               WHEN (a.true_score - b.true_score) * (a.predicted_score - b.predicted_score) > 0 THEN 1.0 ELSE 0.0 END)
               AS DOUBLE) AS correct, CAST(count(*) AS DOUBLE) AS pairs,
           round(avg(CASE WHEN a.predicted_score = b.predicted_score THEN 0.5
               WHEN (a.true_score - b.true_score) * (a.predicted_score - b.predicted_score) > 0 THEN 1.0 ELSE 0.0 END),
               6) AS pairwise_accuracy
    FROM oof a JOIN oof b ON a.category = b.category AND a.item < b.item
    WHERE a.true_score <> b.true_score GROUP BY 1""")
def _(t):
    d = M.pairwise_accuracy(t.oof, ["category"], strict=True)
    return d.withColumn("pairwise_accuracy", R6("pairwise_accuracy"))


@query("m15_model_delta", uses="oof_multi", oracle=MM + """
    SELECT model, round(micro, 6) AS micro, round(micro - (SELECT micro FROM mm WHERE model = 'tax'), 6) AS delta
    FROM mm""")
def _(t):
    board = M.micro_macro(M.pairwise_accuracy(t.oof_multi, ["model", "category"]), ["model"]).select("model", "micro")
    return M.model_delta(board, "tax", [], "micro").select("model", R6("micro"), R6("delta"))


@query("x22_random_recall", uses="oof", oracle="""
    SELECT round(avg(least(1, n) / n), 6) AS random_recall_at_1, round(avg(least(3, n) / n), 6) AS random_recall_at_3
    FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM oof GROUP BY category)""")
def _(t):
    d = M.random_recall(t.oof, ["category"], [], [1, 3])
    return d.select(R6("random_recall_at_1"), R6("random_recall_at_3"))
