"""Pair, tournament, submission and join queries. Pair lists run on order lines: small groups by nature."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.functions.numeric import expit
from prefrank.operators import conform as C, metrics as M, pairs as P
from prefrank.plans.registry import query

R6 = lambda c: F.round(c, 6).alias(c)
SELF = "FROM order_items a JOIN order_items b ON a.category = b.category AND a.item < b.item"
EVEN = "('0','2','4','6','8','a','c','e')"


@query("j1_items_with_labels", uses="ratings item_labels", oracle="""
    SELECT category, item, avg(similarity) AS mean, any_value(product_type) AS product_type FROM ratings
    LEFT JOIN item_labels l USING (category, item) GROUP BY 1, 2""")
def _(t):
    d = t.ratings.groupBy("category", "item").agg(F.avg("similarity").alias("mean"))
    return d.join(t.item_labels, ["category", "item"], "left").select("category", "item", "mean", "product_type")


@query("j2_ratings_with_labels", uses="ratings item_labels", oracle="""
    SELECT product_type, is_reference, count(*) AS n, sum(similarity) AS total FROM ratings
    LEFT JOIN item_labels USING (category, item) GROUP BY 1, 2""")
def _(t):
    d = t.ratings.join(t.item_labels, ["category", "item"], "left")
    return d.groupBy("product_type", "is_reference").agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("total"))


@query("j3_item_pairs", uses="order_items", oracle=f"SELECT a.category, a.item AS item_1, b.item AS item_2 {SELF}")
def _(t):
    return P.item_pairs(t.order_items, ["category"], "item", [])


@query("j4_model_alignment", uses="oof_multi", oracle="""
    SELECT category, item, a.true_score, a.predicted_score AS price, b.predicted_score AS discount, c.predicted_score AS tax
    FROM oof_multi a JOIN oof_multi b USING (category, item) JOIN oof_multi c USING (category, item)
    WHERE a.model = 'price' AND b.model = 'discount' AND c.model = 'tax' AND a.predicted_score IS NOT NULL
      AND b.predicted_score IS NOT NULL AND c.predicted_score IS NOT NULL""")
def _(t):
    return P.align_models(t.oof_multi, ["price", "discount", "tax"])


@query("j5_matched_submission", oracle="""
    SELECT count(*) AS rows, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS equal
    FROM (SELECT doc_id, quality AS a, toxic AS b FROM labels)""")
def _(t):
    d = P.matched_submission(t.labels.select("doc_id", F.col("toxic").alias("b")), t.labels.select("doc_id", F.col("quality").alias("a")), "doc_id")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("equal"))


@query("j6_two_submissions", uses="judgements", oracle="""
    SELECT count(*) AS n, CAST(sum(CASE WHEN second_arm_flips THEN 0 ELSE 1 END) AS BIGINT) AS same FROM judgements""")
def _(t):
    key = F.concat_ws(":", "category", "item_1", "item_2").alias("test_id")
    j = t.judgements
    a = j.select(key, F.col("prediction").alias("a"))
    b = j.select(key, F.when(F.col("second_arm_flips"), F.when(F.col("prediction") == "1", "2").otherwise("1"))
                 .otherwise(F.col("prediction")).alias("b"))
    return a.join(b, "test_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("same"))


@query("j12_code_translation", uses="judgements", oracle="""
    SELECT category, item_1 + 100 AS item_1, item_2 + 100 AS item_2
    FROM judgements""")
def _(t):
    m = t.order_items.select("category", F.col("item").alias("code"), (F.col("item") + 100).alias("new_code"))
    return P.code_translated(t.judgements.select("category", "item_1", "item_2"), m, ["item_1", "item_2"])


@query("j13_pair_scores", uses="judgements order_items", oracle="""
    SELECT j.category, j.item_1, j.item_2, a.predicted_score AS score_1, b.predicted_score AS score_2 FROM judgements j
    LEFT JOIN order_items a ON a.category = j.category AND a.item = j.item_1
    LEFT JOIN order_items b ON b.category = j.category AND b.item = j.item_2""")
def _(t):
    p = t.judgements.select("category", "item_1", "item_2")
    return P.with_scores(p, t.order_items, "predicted_score").select(
        "category", "item_1", "item_2", "score_1", "score_2")


@query("j15_rated_both", uses="ratings", oracle="""
    SELECT a.category, a.item AS item_1, b.item AS item_2, count(*) AS raters, round(avg(a.similarity - b.similarity), 6) AS mean_gap
    FROM ratings a JOIN ratings b ON a.category = b.category AND a.respondent = b.respondent AND a.item < b.item GROUP BY 1, 2, 3""")
def _(t):
    return P.rated_both(t.ratings).groupBy("category", "item_1", "item_2").agg(
        F.count(F.lit(1)).alias("raters"), F.round(F.avg(F.col("similarity_1") - F.col("similarity_2")), 6).alias("mean_gap"))


@query("j16_scored_and_other_pairs", uses="judgements order_items", oracle="""
    SELECT ok, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM order_items o WHERE o.category = j.category AND o.item = j.item_1 AND o.predicted_score > 3)
      AND EXISTS (SELECT 1 FROM order_items o WHERE o.category = j.category AND o.item = j.item_2 AND o.predicted_score > 3) AS ok FROM judgements j) GROUP BY 1""")
def _(t):
    j = t.judgements.select("category", "item_1", "item_2")
    good = t.order_items.filter("predicted_score > 3")
    ok = j
    for side in ("item_1", "item_2"):
        ok = ok.join(good.select("category", F.col("item").alias(side)), ["category", side], "left_semi")
    rest = j.join(ok, ["category", "item_1", "item_2"], "left_anti")
    return (ok.withColumn("ok", F.lit(True)).unionByName(rest.withColumn("ok", F.lit(False)))
            .groupBy("ok").agg(F.count(F.lit(1)).alias("n")))


@query("j17_default_label", oracle="""
    SELECT coalesce(CAST(quality AS VARCHAR), 'undefined') AS label, count(*) AS n FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.select(F.coalesce(F.col("quality").cast("string"), F.lit("undefined")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("t1_labelled_pairs", uses="order_items", oracle=f"""
    SELECT a.category, a.item AS item_1, b.item AS item_2, CASE WHEN a.true_score > b.true_score THEN a.item ELSE b.item END AS better
    {SELF} WHERE abs(a.true_score - b.true_score) >= 1e-10""")
def _(t):
    return P.labelled_pairs(t.order_items)


@query("t1_tie_count", uses="oof", oracle="""
    SELECT g.category, CAST(count(b.item) AS BIGINT) AS ties FROM oof g
    LEFT JOIN oof b ON g.category = b.category AND g.item < b.item AND abs(g.true_score - b.true_score) < 1e-10 GROUP BY 1""")
def _(t):
    return P.tie_count(t.oof)


@query("t2_pair_counts", uses="oof", oracle="""
    SELECT category, CAST(count(*) * (count(*) - 1) / 2 AS DOUBLE) AS pairs FROM oof GROUP BY 1""")
def _(t):
    return P.pair_count(t.oof)


@query("t3_difference_pairs", uses="order_items", oracle=f"""
    SELECT a.category, a.item AS item_1, b.item AS item_2, l AS label,
           (CASE WHEN (a.true_score > b.true_score) = (l = 1) THEN 1 ELSE -1 END) * (a.predicted_score - b.predicted_score) AS d0
    FROM order_items a JOIN order_items b ON a.category = b.category AND a.item < b.item, (VALUES (CAST(1 AS DOUBLE)), (CAST(0 AS DOUBLE))) v(l)
    WHERE a.true_score <> b.true_score""")
def _(t):
    d = P.difference_pairs(t.order_items.withColumn("x", F.array("predicted_score")), "x")
    return d.select("category", "item_1", "item_2", "label", F.col("diff")[0].alias("d0"))


WEIGHTED = """
    WITH s AS (SELECT l_orderkey AS category, l_linenumber AS item, avg(l_quantity) AS m, coalesce(stddev_samp(l_quantity), 0) AS sd,
      count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT a.category, a.item AS item_1, b.item AS item_2, round(abs(a.m - b.m), 6) AS score_diff,
           CASE WHEN a.sd * a.sd / a.n + b.sd * b.sd / b.n > 0
             THEN round(least(5, abs(a.m - b.m) / sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n)), 6) ELSE 1 END AS t_stat
    FROM s a JOIN s b ON a.category = b.category AND a.item < b.item"""


def _spread(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("category"), F.col("l_linenumber").alias("item")).agg(
        F.avg("l_quantity").alias("m"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))
    return P.item_pairs(s, ["category"], "item", ["m", "sd", "n"])


def _weight(scheme):
    return P.pair_weight(scheme, F.col("m_1") - F.col("m_2"), F.col("sd_1"), F.col("n_1"), F.col("sd_2"), F.col("n_2"))


@query("t4_pair_weights", oracle=WEIGHTED)
def _(t):
    return _spread(t).select("category", "item_1", "item_2", F.round(_weight("score_diff"), 6).alias("score_diff"),
                             F.round(_weight("t_stat"), 6).alias("t_stat"))


@query("t4_pair_p_weights")
def _(t):
    return _spread(t).select("category", "item_1", "item_2", F.round(_weight("p_value"), 6).alias("p_weight"))


@query("t5_tournament_scores", uses="oof", oracle="""
    SELECT a.category, a.item, round(coalesce(sum(1 / (1 + exp(-(a.predicted_score - b.predicted_score) / 100000))), 0), 6) AS tournament_score
    FROM oof a LEFT JOIN (SELECT * FROM oof WHERE item % 3 > 0) b ON a.category = b.category GROUP BY 1, 2""")
def _(t):
    d = t.oof.withColumn("s", F.col("predicted_score") / F.lit(100000.0))
    return P.tournament_scores(d, d.filter("item % 3 > 0"), "s").select("category", "item", R6("tournament_score"))


@query("x16_pair_probability", uses="judgements", oracle="""
    SELECT category, item_1, item_2, round(1 / (1 + exp(-(score_1 - score_2) / 10)), 6) AS p FROM judgements""")
def _(t):
    p = expit((F.col("score_1") - F.col("score_2")) / F.lit(10.0))
    return t.judgements.select("category", "item_1", "item_2", F.round(p, 6).alias("p"))


@query("t6_win_rates", uses="judgements order_items", oracle="""
    WITH s AS (SELECT category, item_1 AS item, CASE WHEN prediction = '1' THEN 1 ELSE 0 END AS won FROM judgements WHERE status = 'OK'
      UNION ALL SELECT category, item_2, CASE WHEN prediction = '2' THEN 1 ELSE 0 END FROM judgements WHERE status = 'OK')
    SELECT o.category, o.item, round(coalesce(avg(won), 0.5), 6) AS win_rate FROM order_items o
    LEFT JOIN s ON s.category = o.category AND s.item = o.item GROUP BY 1, 2""")
def _(t):
    return P.win_rates(t.judgements, t.order_items).select("category", "item", R6("win_rate"))


@query("t7_swapped_pairs", uses="order_items", oracle=f"""
    SELECT category, CASE WHEN c THEN j ELSE i END AS item_1, CASE WHEN c THEN i ELSE j END AS item_2 FROM (
      SELECT a.category, a.item AS i, b.item AS j, substr(md5(concat_ws(':', a.category, a.item, b.item, 7)), 32, 1) IN {EVEN} AS c {SELF})""")
def _(t):
    return P.swapped_pairs(t.order_items, 7)


@query("t8_solution_labels", uses="judgements", oracle="""
    SELECT category, item_1, item_2, CASE WHEN status = 'OK' AND score_1 > score_2 THEN item_1
      WHEN status = 'OK' AND score_2 > score_1 THEN item_2 ELSE -1 END AS better FROM judgements""")
def _(t):
    c = F.col
    label = P.solution_label(c("score_1"), c("score_2"), c("item_1"), c("item_2"), c("status") == "OK")
    return t.judgements.select("category", "item_1", "item_2", label.alias("better"))


HALF_KNOWN = "CASE WHEN item_1 % 3 = 0 THEN NULL ELSE score_1 END", "CASE WHEN item_2 % 4 = 0 THEN NULL ELSE score_2 END"


def _half_known(t):
    return t.judgements.withColumn("s1", F.when(F.col("item_1") % 3 != 0, F.col("score_1"))).withColumn(
        "s2", F.when(F.col("item_2") % 4 != 0, F.col("score_2")))


@query("t9_submission_choice", uses="judgements", oracle=f"""
    SELECT category, item_1, item_2, CASE WHEN (s1 IS NULL AND s2 IS NOT NULL) OR s2 > s1 THEN item_2 ELSE item_1 END AS choice
    FROM (SELECT *, {HALF_KNOWN[0]} AS s1, {HALF_KNOWN[1]} AS s2 FROM judgements)""")
def _(t):
    c = F.col
    return _half_known(t).select("category", "item_1", "item_2",
                                 P.submission_choice(c("s1"), c("s2"), c("item_1"), c("item_2")).alias("choice"))


@query("t10_hashed_submission", uses="judgements", oracle=f"""
    SELECT count(*) AS pairs, CAST(sum(CASE WHEN s1 IS NULL OR s2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown,
      CAST(sum(CASE WHEN s1 = s2 THEN 1 ELSE 0 END) AS BIGINT) AS tied, CAST(sum(CASE WHEN s1 > s2 THEN item_1 WHEN s2 > s1 THEN item_2
        WHEN substr(md5(concat_ws(':', 'fallback', item_1, item_2, 3)), 32, 1) IN {EVEN} THEN item_2 ELSE item_1 END) AS BIGINT) AS answer_sum
    FROM (SELECT *, {HALF_KNOWN[0]} AS s1, {HALF_KNOWN[1]} AS s2 FROM judgements)""")
def _(t):
    c = F.col
    d = _half_known(t).withColumn("a", P.hashed_submission(c("s1"), c("s2"), c("item_1"), c("item_2"), 3))
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return d.agg(F.count(F.lit(1)).alias("pairs"), one(c("s1").isNull() | c("s2").isNull()).alias("unknown"),
                 one(c("s1") == c("s2")).alias("tied"), F.sum("a").alias("answer_sum"))


@query("t11_fallback_answers", uses="judgements", oracle=f"""
    SELECT category, item_1, item_2, CASE WHEN status = 'OK' THEN prediction WHEN
      substr(md5(concat_ws(':', 'fallback', item_1, item_2, 42)), 32, 1) IN {EVEN} THEN '2' ELSE '1' END AS answer FROM judgements""")
def _(t):
    coin = F.when(P.md5_is_even("fallback", F.col("item_1"), F.col("item_2"), 42), "2").otherwise("1")
    return t.judgements.select("category", "item_1", "item_2",
                               F.when(F.col("status") == "OK", F.col("prediction")).otherwise(coin).alias("answer"))


@query("t12_submission_score", uses="judgements", oracle="""
    WITH s AS (SELECT CASE WHEN CAST(category AS BIGINT) % 2 = 0 THEN 'Public' ELSE 'Private' END AS usage, CASE WHEN score_1 > score_2 THEN item_1
      WHEN score_2 > score_1 THEN item_2 ELSE -1 END AS better, CASE WHEN prediction = '1' THEN item_1 ELSE item_2 END AS answer FROM judgements)
    SELECT usage, round(avg(CASE WHEN answer = better THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM s WHERE better <> -1 GROUP BY 1""")
def _(t):
    c = F.col
    d = t.judgements.withColumn("test_id", F.concat_ws(":", "category", "item_1", "item_2"))
    sol = d.select("test_id", F.when(c("category").cast("long") % 2 == 0, "Public").otherwise("Private").alias("usage"),
                   P.solution_label(c("score_1"), c("score_2"), c("item_1"), c("item_2"), F.lit(True)).alias("better"))
    ans = d.select("test_id", F.when(c("prediction") == "1", c("item_1")).otherwise(c("item_2")).alias("answer"))
    return P.submission_score(ans, sol).select("usage", R6("accuracy"), "n")


KAPPA = """
    SELECT {by} count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement,
      round((avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - (avg(2 - a) * avg(2 - b) + avg(a - 1) * avg(b - 1)))
        / (1 - (avg(2 - a) * avg(2 - b) + avg(a - 1) * avg(b - 1))), 6) AS kappa
    FROM (SELECT item_1, CAST(prediction AS INT) AS a, CASE WHEN second_arm_flips THEN 3 - CAST(prediction AS INT)
      ELSE CAST(prediction AS INT) END AS b FROM judgements) {group}"""


def _arms(t):
    a = F.col("prediction").cast("int")
    return t.judgements.select("item_1", a.alias("a"), F.when(F.col("second_arm_flips"), 3 - a).otherwise(a).alias("b"))


@query("m13_agreement_kappa", uses="judgements", oracle=KAPPA.format(by="", group=""))
def _(t):
    return M.submission_agreement(_arms(t), "a", "b", []).select("n", R6("agreement"), R6("kappa"))


@query("m13_agreement_kappa_by_group", uses="judgements", oracle=KAPPA.format(by="item_1,", group="GROUP BY item_1"))
def _(t):
    return M.submission_agreement(_arms(t), "a", "b", ["item_1"]).select("item_1", "n", R6("agreement"), R6("kappa"))


@query("b17_flip_rate", uses="judgements", oracle="""
    SELECT round(avg(CASE WHEN second_arm_flips THEN 1.0 ELSE 0.0 END), 6) AS flip_rate,
      round(avg(CASE WHEN (CASE WHEN second_arm_flips THEN 3 - CAST(prediction AS INT) ELSE CAST(prediction AS INT) END = 1) = (score_1 > score_2) THEN 1.0 ELSE 0.0 END)
      - avg(CASE WHEN (prediction = '1') = (score_1 > score_2) THEN 1.0 ELSE 0.0 END), 6) AS accuracy_delta
    FROM judgements WHERE score_1 <> score_2""")
def _(t):
    from prefrank.operators.resample import paired_arms

    a = F.col("prediction") == "1"
    d = t.judgements.filter("score_1 <> score_2").select(
        a.alias("a"), F.when(F.col("second_arm_flips"), ~a).otherwise(a).alias("b"), (F.col("score_1") > F.col("score_2")).alias("truth"))
    return paired_arms(d).select(R6("flip_rate"), R6("accuracy_delta"))


@query("b16_flagged_vs_clean", uses="judgements", oracle="""
    SELECT second_arm_flips AS flagged, count(*) AS n, round(avg(CASE WHEN (prediction = '1') = (score_1 > score_2) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      round(avg(abs(score_1 - score_2)), 6) AS margin FROM judgements WHERE score_1 <> score_2 GROUP BY 1""")
def _(t):
    ok = (F.col("prediction") == "1") == (F.col("score_1") > F.col("score_2"))
    return t.judgements.filter("score_1 <> score_2").groupBy(F.col("second_arm_flips").alias("flagged")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.round(F.avg(F.abs(F.col("score_1") - F.col("score_2"))), 6).alias("margin"))
