"""Filters, aggregates, ranks and scalar functions over the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.functions import numeric as N, text as X
from prefrank.functions.hashing import md5_is_even
from prefrank.operators import conform as C, ranking as R
from prefrank.plans.registry import query

MEAT, DAIRY = ["click", "view", "error"], ["signup", "purchase"]
R6 = lambda c: F.round(c, 6).alias(c)
rnd = lambda d, *cols: d.select(*[F.round(c, 6).alias(c) if c in cols else c for c in d.columns])


@query("f1_category_year_filter", uses="ratings", oracle="""
    SELECT category, respondent, item, similarity, year FROM ratings
    WHERE category NOT IN ('error') AND year IN (2025, 2026)""")
def _(t):
    return C.keep_years(t.ratings, ["error"], [2025, 2026]).select("category", "respondent", "item", "similarity", "year")


@query("f2_rated_items", uses="oof", oracle="""
    SELECT category, item FROM oof WHERE EXISTS (SELECT 1 FROM (SELECT p_brand AS c, p_partkey AS i FROM part
      JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 49) r
      WHERE r.c = category AND r.i = item)""")
def _(t):
    r = (t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
         .select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("item"),
                 F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), F.col("l_quantity")).alias("similarity")))
    return C.rated_only(t.oof, r).select("category", "item")


@query("f3_latest_year", uses="products", oracle="""
    SELECT category, cleaned_ingredients, year, item FROM (
      SELECT *, row_number() OVER (PARTITION BY category, cleaned_ingredients ORDER BY year DESC, item) AS r
      FROM products) WHERE r = 1""")
def _(t):
    d = t.products.select("category", "cleaned_ingredients", "year", "item")
    return C.latest_per_key(d, ["category", "cleaned_ingredients"], "year", "item")


@query("f4_analog_flag", uses="ratings item_labels", oracle="""
    SELECT category, item, NOT ((category IN ('click', 'view', 'error') AND coalesce(has_meat, false))
                             OR (category IN ('signup', 'purchase') AND coalesce(has_dairy, false))) AS is_analog
    FROM item_labels""")
def _(t):
    flag = C.is_analog(F.col("category"), F.col("has_meat"), F.col("has_dairy"), MEAT, DAIRY)
    return t.item_labels.select("category", "item", flag.alias("is_analog"))


@query("f5_non_analog_anti", uses="ratings item_labels", oracle="""
    SELECT category, item, count(*) AS n FROM ratings r WHERE NOT EXISTS (
      SELECT 1 FROM item_labels l WHERE l.category = r.category AND l.item = r.item AND l.has_meat) GROUP BY 1, 2""")
def _(t):
    return C.without_keys(t.ratings, t.item_labels.filter("has_meat")).groupBy("category", "item").agg(F.count(F.lit(1)).alias("n"))


@query("f6_animal_reference", uses="ratings item_labels", oracle="""
    SELECT category, item FROM item_labels WHERE product_type LIKE 'animal%'""")
def _(t):
    return t.item_labels.filter(F.col("product_type").startswith("animal")).select("category", "item")


@query("f7_sanity_caps", uses="products", oracle="""
    SELECT item, CASE WHEN potassium_mg > 5000 THEN NULL ELSE potassium_mg END AS potassium_mg,
           CASE WHEN serving_g > 400 THEN NULL ELSE serving_g END AS serving_g FROM products""")
def _(t):
    return t.products.select("item", C.capped(F.col("potassium_mg"), 5000).alias("potassium_mg"),
                             C.capped(F.col("serving_g"), 400).alias("serving_g"))


@query("f8_ml_to_grams", uses="products", oracle="""
    SELECT item, CASE WHEN serving_unit = 'milliliters' THEN round_even(serving_g * 1.03::DOUBLE * 10, 0) / 10 ELSE serving_g END
      AS serving_g FROM products""")
def _(t):
    return t.products.select("item", C.to_grams(F.col("serving_g"), F.col("serving_unit")).alias("serving_g"))


@query("f9_round_facts", uses="products", oracle="""
    SELECT item, round_even(calories, 0) AS calories, round_even(fat_g * 10, 0) / 10 AS fat_g FROM products""")
def _(t):
    return t.products.select("item", N.round_half_even(F.col("calories"), 0).alias("calories"), N.round_half_even(F.col("fat_g"), 1).alias("fat_g"))


@query("f10_presentation", uses="products", oracle="""
    SELECT category AS "Category", item AS "Product code", cleaned_ingredients AS "Ingredient List"
    FROM products ORDER BY 1, 2""")
def _(t):
    return (t.products.select("category", "item", "cleaned_ingredients")
            .withColumnsRenamed({"category": "Category", "item": "Product code", "cleaned_ingredients": "Ingredient List"})
            .orderBy("Category", "Product code"))


@query("f11_complete_models", uses="oof_multi", oracle="""
    SELECT model, count(*) AS n FROM oof_multi WHERE true_score IS NOT NULL AND predicted_score IS NOT NULL
    GROUP BY model HAVING count(*) >= 1900""")
def _(t):
    return C.complete_models(t.oof_multi, 1900).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("f12_min_group_size", uses="oof", oracle="""
    SELECT category, item FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n FROM oof) WHERE n >= 80""")
def _(t):
    return C.big_groups(t.oof, ["category"], 80).select("category", "item")


@query("f13_keyword_audit", oracle="""
    SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(string_split(lower(
        replace(text, ' ', ',')), ','), lambda x: trim(x))), lambda x: x IN ('the', 'and', 'en'))), '+') AS hits
    FROM documents WHERE list_has_any(list_transform(string_split(lower(
        replace(text, ' ', ',')), ','), lambda x: trim(x)), ['the', 'and', 'en'])""")
def _(t):
    hits = X.animal_hits(F.replace(F.col("text"), F.lit(" "), F.lit(",")), ["the", "and", "en"])
    return (t.documents.select("doc_id", hits.alias("h")).filter(F.size("h") > 0)
            .select("doc_id", F.array_join("h", "+").alias("hits")))


@query("f14_ingredient_dedup", uses="products", oracle="""
    SELECT item, array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: {'x': x, 'i': i}),
        lambda s: list_position(l, s.x) = s.i), lambda s: s.x), '|') AS ingredients
    FROM (SELECT item, list_filter(list_transform(string_split(cleaned_ingredients, '|'), lambda x: trim(x)), lambda x: x <> '') AS l
          FROM products)""")
def _(t):
    return t.products.select("item", F.array_join(F.array_distinct(X.pipe_list(F.col("cleaned_ingredients"))), "|").alias("ingredients"))


@query("f15_skip_list", uses="products", oracle="""
    SELECT item, ing FROM (SELECT item, trim(unnest(string_split(cleaned_ingredients, '|'))) AS ing FROM products)
    WHERE ing <> '' AND lower(ing) NOT IN ('water', 'promo')""")
def _(t):
    d = t.products.select("item", F.explode(X.pipe_list(F.col("cleaned_ingredients"))).alias("ing"))
    return d.filter(~F.lower("ing").isin("water", "promo"))


@query("a1_mean_rating", uses="ratings", oracle="""
    SELECT category, item, round(avg(similarity), 6) AS mean FROM ratings GROUP BY 1, 2""")
def _(t):
    return rnd(C.rating_stats(t.ratings).select("category", "item", "mean"), "mean")


@query("a2_rating_std", uses="ratings", oracle="""
    SELECT category, respondent, round(coalesce(stddev_samp(similarity), 0), 6) AS std, count(similarity) AS count
    FROM ratings GROUP BY 1, 2""")
def _(t):
    return rnd(C.rating_stats(t.ratings, ["category", "respondent"]).select("category", "respondent", "std", "count"), "std")


@query("a3_mean_sum_count", uses="ratings", oracle="""
    SELECT category, item, round(avg(similarity), 6) AS mean, sum(similarity) AS sum, count(similarity) AS count
    FROM ratings GROUP BY 1, 2""")
def _(t):
    return rnd(C.rating_stats(t.ratings).select("category", "item", "mean", "sum", "count"), "mean")


@query("a4_leave_one_out_mean", uses="ratings", oracle="""
    SELECT category, item, respondent, round((s - similarity) / (n - 1), 6) AS loo_mean FROM (
      SELECT *, sum(similarity) OVER (PARTITION BY category, item) AS s,
             count(similarity) OVER (PARTITION BY category, item) AS n FROM ratings) WHERE n > 1""")
def _(t):
    return C.leave_one_out_mean(t.ratings).select("category", "item", "respondent", R6("loo_mean"))


@query("a7_distinct_counts", uses="ratings", oracle="""
    SELECT count(DISTINCT category) AS categories, count(DISTINCT respondent) AS panelists,
           count(DISTINCT (category, item)) AS items FROM ratings""")
def _(t):
    return t.ratings.agg(F.countDistinct("category").alias("categories"), F.countDistinct("respondent").alias("panelists"),
                         F.countDistinct("category", "item").alias("items"))


@query("a8_class_histogram", oracle="SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1")
def _(t):
    return t.labels.groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("a9_class_weights", oracle="""
    WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1), d AS (SELECT * FROM (VALUES (0), (1), (2)) v(label)),
    n AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c)
    SELECT CAST(d.label AS BIGINT) AS label, round(coalesce(total / (3 * n), 1), 6) AS balanced,
           round(coalesce(sqrt(total / (3 * n)), 1), 6) AS root
    FROM d LEFT JOIN c ON c.label = d.label, n""")
def _(t):
    a = C.class_weights(t.labels, "quality", [0, 1, 2], "balanced").withColumnRenamed("weight", "balanced")
    b = C.class_weights(t.labels, "quality", [0, 1, 2], "sqrt").withColumnRenamed("weight", "root")
    return rnd(a.join(b, "label"), "balanced", "root")


@query("a10_zero_profile", uses="products", oracle="""
    SELECT category, CAST(grouping(category) AS BIGINT) AS is_total,
           round(avg(CASE WHEN fat_g = 0 THEN 1.0 WHEN fat_g IS NOT NULL THEN 0.0 END), 6) AS fat_g_zero_rate,
           round(avg(CASE WHEN fat_g <> 0 THEN fat_g END), 6) AS fat_g_mean,
           round(stddev_samp(CASE WHEN fat_g <> 0 THEN fat_g END), 6) AS fat_g_std,
           round(avg(CASE WHEN fat_g IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fat_g_null_rate
    FROM products GROUP BY GROUPING SETS ((category), ())""")
def _(t):
    d = C.zero_profile(t.products, ["fat_g"])
    return rnd(d, "fat_g_zero_rate", "fat_g_mean", "fat_g_std", "fat_g_null_rate")


@query("a11_joint_null_rate", uses="products", oracle="""
    SELECT category, round(avg(CASE WHEN sodium_mg IS NULL AND potassium_mg IS NULL THEN 1.0 ELSE 0.0 END), 6)
      AS joint_null_rate FROM products GROUP BY 1""")
def _(t):
    return rnd(C.joint_null_rate(t.products, ["sodium_mg", "potassium_mg"], ["category"]), "joint_null_rate")


@query("a12_quantiles", uses="oof", oracle="""
    SELECT category, round(quantile_cont(predicted_score, 0.25), 6) AS q25, round(median(predicted_score), 6) AS q50,
           round(quantile_cont(predicted_score, 0.75), 6) AS q75,
           round(quantile_cont(predicted_score, 0.75) - quantile_cont(predicted_score, 0.25), 6) AS iqr
    FROM oof GROUP BY 1""")
def _(t):
    q = C.quantiles(t.oof, ["category"], "predicted_score", [.25, .5, .75])
    d = q.select("category", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    return rnd(d.withColumn("iqr", F.col("q75") - F.col("q25")), "q25", "q50", "q75", "iqr")


@query("a13_variation_correlation", uses="oof", oracle="""
    SELECT category, round(stddev_samp(true_score) / avg(true_score), 6) AS cv,
           round(corr(true_score, predicted_score), 6) AS pearson_r FROM oof GROUP BY 1""")
def _(t):
    return rnd(C.variation_and_correlation(t.oof, ["category"], "true_score", "predicted_score"), "cv", "pearson_r")


@query("a15_rater_item_pivot", uses="ratings", oracle="""
    SELECT category, respondent, max(CASE WHEN item = 0 THEN similarity END) AS "0",
           max(CASE WHEN item = 1 THEN similarity END) AS "1", max(CASE WHEN item = 2 THEN similarity END) AS "2",
           max(CASE WHEN item = 3 THEN similarity END) AS "3", max(CASE WHEN item = 4 THEN similarity END) AS "4",
           max(CASE WHEN item = 5 THEN similarity END) AS "5" FROM ratings GROUP BY 1, 2""")
def _(t):
    return t.ratings.groupBy("category", "respondent").pivot("item", [0, 1, 2, 3, 4, 5]).agg(F.first("similarity", True))


@query("a16_source_crosstab", uses="products", oracle="""
    SELECT category, count(*) FILTER (WHERE source = 'panel') AS panel,
           count(*) FILTER (WHERE source = 'external') AS external, count(*) AS total_products FROM products GROUP BY 1""")
def _(t):
    return C.source_crosstab(t.products, ["panel", "external"])


@query("a17_call_diagnostics", oracle="""
    SELECT count(*) AS calls, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
           CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, min(value) AS min_latency,
           max(value) AS max_latency, round(avg(value), 6) AS mean_latency, CAST(sum(user_id) AS BIGINT) AS prompt_tokens,
           CAST(sum(event_id) AS BIGINT) AS completion_tokens FROM events""")
def _(t):
    log = t.events.select(F.when(F.col("event_type") == "error", "API_FAIL").otherwise("OK").alias("status"),
                          F.col("value").alias("elapsed_seconds"), F.col("user_id").alias("prompt_tokens"),
                          F.col("event_id").alias("completion_tokens"))
    return rnd(C.call_diagnostics(log), "mean_latency")


@query("a18_score_spread", uses="oof", oracle="""
    SELECT category, min(predicted_score) AS min_score, max(predicted_score) AS max_score,
           round(avg(predicted_score), 4) AS mean_score, round(stddev_pop(predicted_score), 4) AS std_score
    FROM oof GROUP BY 1""")
def _(t):
    d = C.score_spread(t.oof, ["category"], "predicted_score")
    return d.select("category", "min_score", "max_score", F.round("mean_score", 4).alias("mean_score"),
                    F.round("std_score", 4).alias("std_score"))


@query("w1_average_rank", uses="oof", oracle="""
    SELECT category, item, rank() OVER (PARTITION BY category ORDER BY true_score)
           + (count(*) OVER (PARTITION BY category, true_score) - 1) / 2.0::DOUBLE AS avg_rank FROM oof""")
def _(t):
    return R.add_average_rank(t.oof, ["category"], "true_score").select("category", "item", "avg_rank")


@query("w2_rank_pct", uses="oof_multi", oracle="""
    SELECT model, category, item, CASE WHEN predicted_score IS NOT NULL THEN
      round((rank() OVER (PARTITION BY model, category ORDER BY predicted_score NULLS LAST)
        + (count(*) OVER (PARTITION BY model, category, predicted_score) - 1) / 2.0::DOUBLE)
        / count(predicted_score) OVER (PARTITION BY model, category), 6) END AS rank_pct FROM oof_multi""")
def _(t):
    d = R.add_rank_pct(t.oof_multi, ["model", "category"], "predicted_score")
    return d.select("model", "category", "item", R6("rank_pct"))


@query("w3_min_rank_desc", uses="oof", oracle="""
    SELECT category, item, rank() OVER (PARTITION BY category ORDER BY true_score DESC) AS min_rank FROM oof""")
def _(t):
    return R.add_min_rank_desc(t.oof, ["category"], "true_score").select("category", "item", "min_rank")


@query("w4_rank_normalised", uses="oof", oracle="""
    SELECT category, item, round(count(*) OVER (PARTITION BY category ORDER BY true_score RANGE UNBOUNDED PRECEDING)
      / (count(*) OVER (PARTITION BY category) + 1), 6) AS rank_norm FROM oof""")
def _(t):
    return R.add_rank_normalised(t.oof, ["category"], "true_score").select("category", "item", R6("rank_norm"))


@query("w5_minmax", uses="oof", oracle="""
    SELECT category, item, round((predicted_score - min(predicted_score) OVER ()) /
      (max(predicted_score) OVER () - min(predicted_score) OVER ()), 6) AS minmax FROM oof""")
def _(t):
    return R.add_minmax(t.oof, [], "predicted_score").select("category", "item", R6("minmax"))


@query("w6_canonical_order", uses="oof", oracle="""
    SELECT category, true_score, predicted_score, row_number() OVER (ORDER BY category, true_score, predicted_score) - 1
      AS pos FROM oof""")
def _(t):
    d = t.oof.withColumn("_k", F.struct("category", "true_score", "predicted_score", "item"))  # items make it unique
    return R.add_sequence(d, "_k", "pos").select("category", "true_score", "predicted_score", "pos")


@query("w7_top_components", oracle="""
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS r
      FROM lineitem) WHERE r <= 3""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return C.top_k(d, ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_partkey"), F.col("l_linenumber")], 3)


@query("w8_top_by_position", uses="products", oracle="""
    SELECT item, pos, ing FROM (SELECT item, unnest(list_filter(list_transform(string_split(cleaned_ingredients, '|'),
      lambda x: trim(x)), lambda x: x <> '')) AS ing, generate_subscripts(list_filter(list_transform(string_split(
      cleaned_ingredients, '|'), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS pos FROM products) WHERE pos < 2""")
def _(t):
    d = t.products.select("item", F.posexplode(X.pipe_list(F.col("cleaned_ingredients"))).alias("pos", "ing"))
    return C.top_k(d, ["item"], [F.col("pos")], 2).withColumn("pos", F.col("pos").cast("long"))


@query("w9_best_position", uses="oof", oracle="""
    SELECT o.category, sum(CASE WHEN predicted_score > bp THEN 1 ELSE 0 END)::BIGINT + 1 AS best_position FROM oof o
    JOIN (SELECT category, arg_max(predicted_score, (true_score, -predicted_score)) AS bp FROM oof GROUP BY 1) b
      ON b.category = o.category GROUP BY 1""")
def _(t):
    return R.best_position(t.oof, ["category"])


@query("w10_best_model", uses="oof_multi", oracle="""
    WITH m AS (SELECT model, category, corr(true_score, predicted_score) AS r FROM oof_multi GROUP BY 1, 2)
    SELECT category, arg_max(model, r) AS model, round(max(r), 6) AS r FROM m GROUP BY 1""")
def _(t):
    m = C.variation_and_correlation(t.oof_multi.dropna(), ["model", "category"], "true_score", "predicted_score")
    return rnd(R.best_by(m.withColumnRenamed("pearson_r", "r"), ["category"], "model", "r"), "r")


@query("w11_quantile_bins", uses="oof", oracle="""
    WITH e AS (SELECT quantile_cont(predicted_score, 0.2) AS a, quantile_cont(predicted_score, 0.4) AS b,
      quantile_cont(predicted_score, 0.6) AS c, quantile_cont(predicted_score, 0.8) AS d FROM oof)
    SELECT item, CAST(CASE WHEN predicted_score <= a THEN 1 WHEN predicted_score <= b THEN 2 WHEN predicted_score <= c THEN 3
      WHEN predicted_score <= d THEN 4 ELSE 5 END AS BIGINT) AS bin FROM oof, e""")
def _(t):
    return R.add_quantile_bin(t.oof, "predicted_score").select("item", "bin")


@query("w13_sequence_ids", oracle="SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents")
def _(t):
    return R.add_sequence(t.documents.select("doc_id"), "doc_id", "seq")


@query("x1_pipe_list", uses="products", oracle="""
    SELECT item, len(l) AS n, array_to_string(l, ';') AS parts FROM (SELECT item, list_filter(list_transform(
      string_split(cleaned_ingredients, '|'), lambda x: trim(x)), lambda x: x <> '') AS l FROM products)""")
def _(t):
    p = X.pipe_list(F.col("cleaned_ingredients"))
    return t.products.select("item", F.size(p).cast("long").alias("n"), F.array_join(p, ";").alias("parts"))


@query("x2_inverse_rank_weights", oracle="""
    SELECT p_partkey, i - 1 AS pos, round((1.0 / i) / (SELECT sum(1.0 / j) FROM range(1, p_size + 1) r(j)), 6) AS w
    FROM part, range(1, p_size + 1) r(i)""")
def _(t):
    d = t.part.select("p_partkey", F.posexplode(N.inverse_rank_weights(F.col("p_size"))).alias("pos", "w"))
    return d.select("p_partkey", F.col("pos").cast("long").alias("pos"), R6("w"))


@query("x3_one_hot", oracle="""
    SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN concat_ws(',',
      CAST(CAST(p_type = 'ECONOMY' AS INT) AS VARCHAR), CAST(CAST(p_type = 'SMALL' AS INT) AS VARCHAR),
      CAST(CAST(p_type = 'PROMO' AS INT) AS VARCHAR)) END AS hot FROM part""")
def _(t):
    v = N.one_hot(F.col("p_type"), ["ECONOMY", "SMALL", "PROMO"])
    return t.part.select("p_partkey", F.when(v.isNotNull(), F.array_join(v.cast("array<int>").cast("array<string>"), ",")).alias("hot"))


@query("x4_ingredient_set", uses="products", oracle=r"""
    SELECT item, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(ingredients,
      '\([^)]*\)', '', 'g'), ','), lambda x: lower(trim(x))), lambda x: length(x) > 1))), ';') AS tokens FROM products""")
def _(t):
    return t.products.select("item", F.array_join(F.array_sort(X.ingredient_set(F.col("ingredients"))), ";").alias("tokens"))


@query("x5_strip_brand", oracle=r"""
    SELECT p_partkey, regexp_replace(concat(p_type, ' & Co.: ', p_name, ', salt: fine'),
      '^[A-Za-z][A-Za-z\s''’.&®™️()-]*?:\s*', '') AS text FROM part""")
def _(t):
    return t.part.select("p_partkey", X.strip_brand(F.concat("p_type", F.lit(" & Co.: "), "p_name", F.lit(", salt: fine"))).alias("text"))


@query("x6_strip_marks", oracle="""
    SELECT p_partkey, replace(replace(replace(replace(concat(p_name, '® ', p_type, '™  ©x'), '™', ''), '®', ''), '©', ''), '  ', ' ')
      AS text FROM part""")
def _(t):
    return t.part.select("p_partkey", X.strip_marks(F.concat("p_name", F.lit("® "), "p_type", F.lit("™  ©x"))).alias("text"))


@query("x7_title_caps", oracle=r"""
    WITH s AS (SELECT p_partkey, upper(concat(p_name, ', ', p_type, CASE WHEN p_size % 2 = 0 THEN ' salt-free mix' ELSE '' END)) AS t FROM part)
    SELECT p_partkey, CASE WHEN length(t) > 20 THEN array_to_string(list_transform(string_split(lower(t), ''), lambda ch, i:
      CASE WHEN i > 1 AND regexp_matches(substr(lower(t), CAST(i - 1 AS BIGINT), 1), '[a-z]') THEN ch ELSE upper(ch) END), '') ELSE t END AS text
    FROM s""")
def _(t):
    s = F.upper(F.concat("p_name", F.lit(", "), "p_type", F.when(F.col("p_size") % 2 == 0, F.lit(" salt-free mix")).otherwise("")))
    return t.part.select("p_partkey", s.alias("s")).select("p_partkey", X.title_caps(F.col("s")).alias("text"))


VARIANTS = " UNION ALL ".join(
    ["SELECT n, n AS v FROM s", r"SELECT n, trim(regexp_replace(n, '\s*\([^)]*\)\s*', ' ', 'g')) FROM s WHERE n LIKE '%(%'",
     "SELECT n, trim(substr(n, 1, length(n) - 13)) FROM s WHERE n LIKE '% food product'"]
    + [f"SELECT n, trim(substr(n, {len(p) + 1})) FROM s WHERE starts_with(n, '{p}') AND length(trim(substr(n, {len(p) + 1}))) > 2"
       for p in X.STRIP_PREFIXES]
    + [f"SELECT n, trim(substr(n, 1, length(n) - {len(p)})) FROM s WHERE ends_with(n, '{p}') AND length(trim(substr(n, 1, length(n) - {len(p)}))) > 2"
       for p in X.STRIP_SUFFIXES]
    + ["SELECT n, replace(n, '-', ' ') FROM s WHERE contains(n, '-')", "SELECT n, replace(n, ' ', '-') FROM s WHERE contains(n, ' ')",
       """SELECT n, CASE WHEN n LIKE '%ies' THEN substr(n, 1, length(n) - 3) || 'y'
         WHEN n LIKE '%es' AND length(n) > 3 THEN substr(n, 1, length(n) - 2)
         WHEN n LIKE '%s' AND length(n) > 2 AND n NOT LIKE '%ss' THEN substr(n, 1, length(n) - 1)
         WHEN regexp_matches(n, '[^aeiou]y$') THEN substr(n, 1, length(n) - 1) || 'ies'
         WHEN regexp_matches(n, '(s|x|ch|sh|z)$') THEN n || 'es' ELSE n || 's' END FROM s"""])


@query("x8_name_variants", oracle=f"""
    WITH s AS (SELECT DISTINCT lower(concat(CASE p_size % 4 WHEN 0 THEN 'ground ' WHEN 1 THEN 'raw-' ELSE '' END, p_name,
       CASE p_size % 5 WHEN 0 THEN ' powder' WHEN 1 THEN ' (dry)' WHEN 2 THEN ' food product' WHEN 3 THEN ' seeds' ELSE '' END)) AS n FROM part)
    SELECT DISTINCT n, v FROM ({VARIANTS}) WHERE v <> ''""")
def _(t):
    pre = F.when(F.col("p_size") % 4 == 0, "ground ").when(F.col("p_size") % 4 == 1, "raw-").otherwise("")
    m = F.col("p_size") % 5
    post = F.when(m == 0, " powder").when(m == 1, " (dry)").when(m == 2, " food product").when(m == 3, " seeds").otherwise("")
    names = t.part.select(F.lower(F.concat(pre, "p_name", post)).alias("n")).distinct()
    return names.select("n", F.explode(X.name_variants(F.col("n"))).alias("v"))


def _bare_sql(c: str) -> str:
    for w in X.MODIFIERS:
        c = rf"regexp_replace({c}, '(?i)\b{w}\b', '', 'g')"
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


@query("x9_match_candidates", oracle=rf"""
    WITH s AS (SELECT DISTINCT concat('Extra Virgin ', p_name, ' Protein ', CASE p_size % 3 WHEN 0 THEN 'Isolate' WHEN 1 THEN 'whole grain' ELSE 'raw' END) AS n FROM part)
    SELECT n, {_bare_sql('n')} AS bare, lower(trim(regexp_replace(regexp_replace(n, '(?i)\bprotein\b', '', 'g'), '\s+', ' ', 'g'))) AS no_protein,
           lower(list_last(string_split(n, ' '))) AS last_word FROM s""")
def _(t):
    m = F.col("p_size") % 3
    n = F.concat(F.lit("Extra Virgin "), "p_name", F.lit(" Protein "), F.when(m == 0, "Isolate").when(m == 1, "whole grain").otherwise("raw"))
    d = t.part.select(n.alias("n")).distinct().withColumn("c", X.match_candidates(F.col("n")))
    return d.select("n", F.col("c")[0].alias("bare"), F.col("c")[1].alias("no_protein"), F.col("c")[2].alias("last_word"))


@query("x11_per_100g", uses="products", oracle="""
    SELECT item, CASE WHEN fat_g IS NULL AND sodium_mg IS NULL THEN NULL ELSE round(coalesce(fat_g * s, 0), 6) END AS fat,
           CASE WHEN fat_g IS NULL AND sodium_mg IS NULL THEN NULL ELSE round(coalesce(sodium_mg * s * 0.001::DOUBLE, 0), 6) END AS sodium
    FROM (SELECT *, CASE WHEN serving_g > 0 THEN 100.0 / serving_g ELSE 1.0 END AS s FROM products)""")
def _(t):
    v = N.per_100g([(F.col("fat_g"), "g"), (F.col("sodium_mg"), "mg")], F.col("serving_g"))
    return t.products.select("item", v.alias("v")).select("item", F.round(F.col("v")[0], 6).alias("fat"), F.round(F.col("v")[1], 6).alias("sodium"))


@query("x12_subset_columns", uses="products", oracle="""
    SELECT item, CASE WHEN category IN ('Brand#1', 'Brand#2') THEN 2 WHEN category = 'Brand#3' THEN 1 END::BIGINT AS dims,
           CASE WHEN category IN ('Brand#1', 'Brand#2', 'Brand#3') THEN coalesce(fat_g, 0) END AS first_value FROM products""")
def _(t):
    s = N.subset_of(F.col("category"), {"a": ["Brand#1", "Brand#2"], "b": ["Brand#3"]})
    fat, sod = F.coalesce("fat_g", F.lit(0.0)), F.coalesce("sodium_mg", F.lit(0.0))
    v = N.by_subset(s, {"a": F.array(fat, sod), "b": F.array(fat)})
    return t.products.select("item", v.alias("v")).select(
        "item", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("dims"), F.col("v")[0].alias("first_value"))


@query("x17_md5_coin", uses="oof", oracle="""
    SELECT item, substr(md5(concat_ws(':', item, item + 1, 42)), 32, 1) IN ('0','2','4','6','8','a','c','e') AS swapped,
           CASE WHEN substr(md5(concat_ws(':', 'fallback', item, item + 1, 42)), 32, 1) IN ('0','2','4','6','8','a','c','e')
             THEN '2' ELSE '1' END AS fallback FROM oof""")
def _(t):
    a, b = F.col("item"), F.col("item") + 1
    return t.oof.select("item", md5_is_even(a, b, 42).alias("swapped"),
                        F.when(md5_is_even("fallback", a, b, 42), "2").otherwise("1").alias("fallback"))


@query("x18_parse_answer", oracle=r"""
    WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(concat(text, chr(10), 'so item ', turn, ' it is', chr(10), ' '), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
    SELECT conv_id, turn, coalesce(nullif(regexp_extract(l[-1], '([12])[^12]*$', 1), ''), nullif(regexp_extract(l[1], '([12])[^12]*$', 1), '')) AS answer FROM s""")
def _(t):
    text = F.concat("text", F.lit("\nso item "), F.col("turn").cast("string"), F.lit(" it is\n "))
    return t.conversations.select("conv_id", "turn", X.parse_answer(text).alias("answer"))


@query("x19_nutrition_text", uses="products", oracle="""
    SELECT item, CASE WHEN serving_g IS NULL OR serving_g <= 0 THEN '' ELSE concat_ws(', ',
      CASE WHEN fat_g <> 0 THEN concat('Total Fat: ', printf('%.1f', fat_g * (100.0 / serving_g)), 'g') END,
      CASE WHEN sodium_mg <> 0 THEN concat('Sodium: ', printf('%.1f', sodium_mg * (100.0 / serving_g)), 'mg') END) END AS text
    FROM products""")
def _(t):
    facts = [("Total Fat", "g", F.col("fat_g")), ("Sodium", "mg", F.col("sodium_mg"))]
    return t.products.select("item", X.nutrition_text(F.col("serving_g"), facts).alias("text"))


@query("x20_interval_overlap", uses="oof", oracle="""
    WITH c AS (SELECT category, avg(predicted_score) - stddev_pop(predicted_score) AS lo,
      avg(predicted_score) + stddev_pop(predicted_score) / 8 AS hi FROM oof GROUP BY 1)
    SELECT a.category, sum(CASE WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN 1 ELSE 0 END)::BIGINT AS overlaps
    FROM c a, c b WHERE b.category IN ('Brand#1', 'Brand#2') GROUP BY 1""")
def _(t):
    p = F.col("predicted_score")
    c = t.oof.groupBy("category").agg((F.avg(p) - F.stddev_pop(p)).alias("lo"), (F.avg(p) + F.stddev_pop(p) / 8).alias("hi"))
    b = c.filter(F.col("category").isin("Brand#1", "Brand#2")).select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    hit = N.intervals_overlap(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))
    return c.crossJoin(F.broadcast(b)).groupBy("category").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("overlaps"))
