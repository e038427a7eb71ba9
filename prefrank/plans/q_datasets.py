"""Dataset construction, gate and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.functions import text as X
from prefrank.operators import datasets as K, gates as G
from prefrank.operators.centroid import subset_names
from prefrank.operators.skew import row_index
from prefrank.plans.registry import query

R6 = lambda c: F.round(c, 6).alias(c)
U = "(CAST('0x' || substr(md5(concat_ws(':', {a})), 1, 8) AS BIGINT) {o}) / 4294967296.0::DOUBLE"
H = "CAST('0x' || substr(md5(concat_ws(':', {a})), 1, 8) AS BIGINT)"


def row_shift(d, keys, col, out):
    """`d` with the next value of `col` in its group, by joined row numbers."""
    n = row_index(d, keys, col, "_i")
    ahead = n.select(*keys, (F.col("_i") - 1).alias("_i"), F.col(col).alias(out))
    return n.join(ahead, [*keys, "_i"], "left").drop("_i")


def rounded(d, *cols):
    return d.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in d.columns])


TOK = r"""
    WITH tk AS (SELECT lang AS category, doc_id AS item, list_distinct(list_filter(list_transform(string_split(regexp_replace(replace(text, ' ', ','), '\([^)]*\)', '', 'g'), ','),
      lambda x: lower(trim(x))), lambda x: length(x) > 1)) AS tokens FROM documents),
    nd AS (SELECT a.category, a.item, min(b.item) AS match FROM tk a JOIN tk b ON a.category = b.category AND a.item % 2 = 1 AND b.item % 2 = 0
      AND len(b.tokens) >= 0.79 * len(a.tokens) AND len(a.tokens) >= 0.79 * len(b.tokens)
      AND len(list_intersect(a.tokens, b.tokens)) >= 0.8 * len(list_distinct(list_concat(a.tokens, b.tokens))) AND len(a.tokens) > 0 GROUP BY 1, 2)
"""


def _tokens(t):
    d = t.documents.select(F.col("lang").alias("category"), F.col("doc_id").alias("item"),
                           X.ingredient_set(F.replace(F.col("text"), F.lit(" "), F.lit(","))).alias("tokens"))
    return d.filter("item % 2 = 1"), d.filter("item % 2 = 0")


@query("k1_near_duplicates", oracle=TOK + "SELECT category, item, match FROM nd")
def _(t):
    return K.near_duplicates(*_tokens(t)).select("category", "item", "match")


@query("k1_without_near_duplicates", oracle=TOK + """
    SELECT category, count(*) AS kept FROM tk WHERE item % 2 = 1 AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.item = tk.item) GROUP BY 1""")
def _(t):
    return K.without_near_duplicates(*_tokens(t)).groupBy("category").agg(F.count(F.lit(1)).alias("kept"))


@query("x10_jaccard", oracle=r"""
    WITH s AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ')) AS b FROM conversations)
    SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s WHERE b IS NOT NULL""")
def _(t):
    a = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.split("text", " ").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("w12_category_quota", uses="products", oracle=f"""
    WITH q AS (SELECT category, count(*) AS quota FROM products WHERE source = 'panel' AND item % 4 = 0 GROUP BY 1),
    r AS (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY {H.format(a="5, item")}, item) AS r FROM products WHERE source = 'external')
    SELECT category, item FROM r LEFT JOIN q USING (category) WHERE quota IS NULL OR r <= quota""")
def _(t):
    quota = t.products.filter("source = 'panel' AND item % 4 = 0").groupBy("category").agg(F.count(F.lit(1)).alias("quota"))
    return K.capped_by_quota(t.products.filter("source = 'external'").select("category", "item"), quota, 5)


ZI = f"""
    WITH st AS (SELECT category, avg(CASE WHEN fat_g = 0 THEN 1.0 WHEN fat_g IS NOT NULL THEN 0.0 END) AS z, avg(CASE WHEN fat_g <> 0 THEN fat_g END) AS m,
      stddev_samp(CASE WHEN fat_g <> 0 THEN fat_g END) AS s FROM products WHERE source = 'panel' GROUP BY 1),
    u AS (SELECT p.*, z, m, s, {U.format(a="9, 'zero', category, item, 'fat_g'", o="")} AS uz, {U.format(a="'r', 9, category, item, 'fat_g'", o="+ 0.5::DOUBLE")} AS u1,
      {U.format(a="'t', 9, category, item, 'fat_g'", o="")} AS u2 FROM (SELECT category, item, fat_g FROM products WHERE source = 'external') p JOIN st USING (category))
"""


@query("k2_zero_inflated_imputation", uses="products", oracle=ZI + """
    SELECT category, item, round(coalesce(fat_g, CASE WHEN uz < z OR m = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, m + s * sqrt(-2 * ln(u1)) * cos(6.283185307179586 * u2)) END), 6) AS fat_g FROM u""")
def _(t):
    d = t.products.select("category", "item", "fat_g", "source")
    out = K.zero_inflated_imputed(d.filter("source = 'external'").drop("source"), d.filter("source = 'panel'"), "fat_g", 9)
    return rounded(out, "fat_g")


@query("k3_null_reinjection", uses="products", oracle=f"""
    WITH r AS (SELECT category, avg(CASE WHEN sodium_mg IS NULL AND potassium_mg IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM products GROUP BY 1)
    SELECT category, item, CASE WHEN u >= r THEN round_even(sodium_mg * 10, 0) / 10 END AS sodium_mg, CASE WHEN u >= r THEN round_even(potassium_mg * 10, 0) / 10 END AS potassium_mg
    FROM (SELECT *, {U.format(a="3, 'null', 0, category, item", o="")} AS u FROM products) JOIN r USING (category)""")
def _(t):
    d = K.nulls_reinjected(t.products, t.products, [["sodium_mg", "potassium_mg"]], 3)
    return d.select("category", "item", "sodium_mg", "potassium_mg")


@query("k4_anonymised_codes", uses="products", oracle=f"""
    SELECT category, item, row_number() OVER (ORDER BY {H.format(a="17, category, item")}, category, item) + 99 AS new_code FROM products""")
def _(t):
    return K.anonymised_codes(t.products.select("category", "item"), 17)


@query("k5_category_codes", uses="products", oracle="""
    SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY source = 'external', item) AS new_code FROM products""")
def _(t):
    return K.category_codes(t.products.filter("source = 'panel'"), t.products)


REKEY = """
    WITH m AS (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY item DESC) AS new_code FROM
        (SELECT category, item + 1000000 AS item FROM products WHERE source = 'panel')),
    u AS (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY item) AS r FROM (SELECT category, item + 1000000 AS item FROM products WHERE source <> 'panel')),
    b AS (SELECT category, count(*) AS base FROM m GROUP BY 1),
    f AS (SELECT category, item, new_code FROM m UNION ALL SELECT category, item, coalesce(base, 0) + r FROM u LEFT JOIN b USING (category))
"""


def _rekey_map(t):
    p = t.products.filter("source = 'panel'").select("category", (F.col("item") + 1000000).alias("item"))
    return K.category_codes(p.withColumn("item", -F.col("item")), p.limit(0)).withColumn("item", -F.col("item"))


@query("k5_rekeyed_features", uses="products", oracle=REKEY + """
    SELECT category, new_code AS item, p.calories, f.item AS original_code FROM f JOIN (SELECT category, item + 1000000 AS item, calories FROM products) p USING (category, item)""")
def _(t):
    features = t.products.select("category", (F.col("item") + 1000000).alias("item"), "calories")
    return K.rekeyed(features, _rekey_map(t), one_row_per_code=True)


@query("j12_rekeyed_pairs", uses="products", oracle=REKEY + """, p AS (SELECT category, item + 1000000 AS item_1, lead(item + 1000000) OVER (PARTITION BY category ORDER BY item) AS item_2 FROM products)
    SELECT category, a.new_code AS item_1, b.new_code AS item_2 FROM p LEFT JOIN f a USING (category) LEFT JOIN f b USING (category)
    WHERE a.item = item_1 AND b.item IS NOT DISTINCT FROM item_2
    UNION ALL SELECT category, a.new_code, NULL FROM p JOIN f a USING (category) WHERE a.item = item_1 AND item_2 IS NULL""")
def _(t):
    p = row_shift(t.products.select("category", (F.col("item") + 1000000).alias("item_1")), ["category"], "item_1", "item_2")
    return K.rekeyed(p, _rekey_map(t), ["item_1", "item_2"], order_col=None)


@query("k6_code_space", uses="products", oracle="""
    WITH m AS (SELECT category, item + 1000000 AS item, row_number() OVER (PARTITION BY category ORDER BY item) AS new_code FROM products),
    i AS (SELECT category, CASE WHEN length(category) % 2 = 0 THEN item + 1000000 ELSE item END AS item FROM products)
    SELECT i.category, CASE WHEN max(o.item) IS NOT NULL AND max(CASE WHEN o.item IS NULL THEN p.new_code END) IS NULL THEN 'original'
      WHEN max(CASE WHEN o.item IS NULL THEN p.new_code END) IS NOT NULL AND max(o.item) IS NULL THEN 'public' ELSE 'unknown' END AS space
    FROM i LEFT JOIN m o ON o.category = i.category AND o.item = i.item LEFT JOIN m p ON p.category = i.category AND p.new_code = i.item GROUP BY 1""")
def _(t):
    p = t.products.select("category", "item")
    m = K.category_codes(p, p).withColumn("item", F.col("item") + 1000000)
    shifted = F.when(F.length("category") % 2 == 0, F.col("item") + 1000000).otherwise(F.col("item"))
    return K.code_space(p.withColumn("item", shifted), m)


@query("k6_contiguous_codes", oracle="""
    SELECT conv_id AS category, min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS contiguous FROM conversations GROUP BY 1""")
def _(t):
    return K.is_contiguous(t.conversations.select(F.col("conv_id").alias("category"), (F.col("turn") + 1).alias("item")))


@query("k7_join_guard", oracle="""
    SELECT CAST(count(*) AS BIGINT) AS matches FROM documents d JOIN benchmark b ON d.text = b.text HAVING count(*) = 0""")
def _(t):
    return G.unmatched_join(t.documents, t.benchmark, ["text"])


@query("k8_public_private", uses="judgements", oracle=f"""
    SELECT category, item_1, item_2, CASE WHEN score_1 = score_2 THEN 'Ignored' WHEN r <= floor(n / 2) THEN 'Public' ELSE 'Private' END AS usage FROM (
      SELECT *, row_number() OVER (PARTITION BY category, score_1 = score_2 ORDER BY {H.format(a="2, item_1, item_2")}, item_1, item_2) AS r,
        count(*) OVER (PARTITION BY category, score_1 = score_2) AS n FROM judgements)""")
def _(t):
    d = K.public_private(t.judgements, F.col("score_1") != F.col("score_2"), ["item_1", "item_2"], 2)
    return d.select("category", "item_1", "item_2", "usage")


@query("k9_group_disjoint_split")
def _(t):
    d = K.group_split(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", 0.15, 0.15, 42)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("l_orderkey").alias("groups"))


@query("k10_fresh_ids", oracle="""
    SELECT part, id, doc_id FROM (SELECT 'train' AS part, row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id FROM labels WHERE doc_id % 3 > 0
    UNION ALL SELECT 'test', row_number() OVER (ORDER BY doc_id) - 1 + (SELECT count(*) FROM labels WHERE doc_id % 3 > 0), doc_id FROM labels WHERE doc_id % 3 = 0)""")
def _(t):
    out = K.fresh_ids({"train": t.labels.filter("doc_id % 3 > 0"), "test": t.labels.filter("doc_id % 3 = 0")}, "doc_id", "quality")
    return out["train"].select(F.lit("train").alias("part"), "id", "doc_id").unionByName(out["test"].select(F.lit("test").alias("part"), "id", "doc_id"))


@query("k11_leakage", oracle="""
    SELECT count(*) AS leaked FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 3 > 0) a
    WHERE EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 = 0 AND b.text = a.text)""")
def _(t):
    return G.leakage(t.documents.filter("doc_id % 3 > 0"), t.documents.filter("doc_id % 3 = 0"), ["text"]).agg(F.count(F.lit(1)).alias("leaked"))


@query("k12_class_drift", oracle="""
    SELECT lang AS label, count(*) AS n, CAST(CASE WHEN lang = 'en' THEN 10 END AS BIGINT) AS expected FROM documents GROUP BY 1
    UNION ALL SELECT 'xx', NULL, 5""")
def _(t):
    return G.class_drift(t.documents, "lang", {"en": 10, "xx": 5}, 3)


@query("k13_output_contract", oracle="""
    SELECT 'ids_shared' AS "check", (SELECT count(*) FROM labels WHERE doc_id % 2 = 0 AND doc_id % 3 = 0) AS violations
    UNION ALL SELECT 'test_and_solution_ids_differ', (SELECT count(*) FROM labels WHERE doc_id % 3 = 0 AND toxic = 1)
    UNION ALL SELECT 'unknown_labels', (SELECT count(*) FROM labels WHERE doc_id % 3 = 0 AND toxic = 0 AND quality = 0) UNION ALL SELECT 'label_in_test', 0""")
def _(t):
    d = t.labels.withColumnRenamed("doc_id", "id").withColumn("label", F.col("quality").cast("string"))
    return G.output_contract(d.filter("id % 2 = 0"), d.filter("id % 3 = 0").drop("label"), d.filter("id % 3 = 0 AND toxic = 0"), "label", ["1"])


@query("k14_matched_missing_rate", uses="products", oracle=f"""
    WITH r AS (SELECT category, sum(CASE WHEN serving_g IS NULL THEN 1 ELSE 0 END) / count(*) AS rate FROM products WHERE source = 'panel' GROUP BY 1),
    e AS (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY {H.format(a="6, item")}, item) AS r, count(*) OVER (PARTITION BY category) AS n
      FROM products WHERE source = 'external')
    SELECT category, item FROM e JOIN r USING (category) WHERE rate > 0 AND r <= greatest(1, round_even(rate * n, 0))""")
def _(t):
    p = t.products.withColumn("gone", F.col("serving_g").isNull())
    return K.dropped_to_rate(p.filter("source = 'external'").select("category", "item"), p.filter("source = 'panel'"), "gone", 6)


@query("k15_golden_values", oracle="""
    SELECT 'rows' AS name, CAST(1 AS DOUBLE) AS expected, CAST(count(*) AS DOUBLE) AS value FROM lineitem""")
def _(t):
    m = t.lineitem.agg(F.count(F.lit(1)).cast("double").alias("value"), F.max("l_linenumber").cast("double").alias("top"))
    m = m.select(F.explode(F.array(F.struct(F.lit("rows").alias("name"), "value"), F.struct(F.lit("top").alias("name"), F.col("top").alias("value")))).alias("e")).select("e.*")
    return G.golden_values(m, {"rows": 1.0, "top": 7.0}, 0.001)


@query("k16_failure_rate", oracle="""
    SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events""")
def _(t):
    return rounded(G.failure_rate(t.events.select((F.col("event_type") == "error").alias("failed")), "failed"), "rate")


@query("o1_source_union", uses="products", oracle="""
    SELECT category, item, year, source FROM products WHERE source = 'panel' UNION ALL SELECT category, item, NULL, source FROM products WHERE source = 'external'""")
def _(t):
    a = t.products.filter("source = 'panel'").select("category", "item", "year", "source")
    return a.unionByName(t.products.filter("source = 'external'").select("category", "item", "source"), allowMissingColumns=True)


@query("o2_split_overlap", oracle="""
    SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def _(t):
    return G.leakage(t.orders.filter("o_orderstatus = 'F'"), t.orders.filter("o_orderstatus = 'O'"), ["o_custkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("o3_set_difference", oracle="""
    SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def _(t):
    return G.set_difference(t.documents.select("doc_id"), t.labels.select("doc_id"))


@query("o4_build_difference", oracle="""
    SELECT CAST(sum(CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, CAST(0.5 AS DOUBLE) AS max_abs_diff FROM embeddings""")
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.filter("vec_id % 5 <> 0").withColumn("v", F.transform("v", lambda x: x + F.lit(0.5)))
    d = G.build_difference(e, b, ["vec_id"], "v")
    return rounded(d, "max_abs_diff")


@query("o5_feature_subsets", uses="oof", oracle="""
    SELECT category, s AS subset, count(*) AS n FROM oof, (VALUES ('a'), ('b'), ('c'), ('ab'), ('ac'), ('bc'), ('abc')) v(s) GROUP BY 1, 2""")
def _(t):
    sets = ["".join(s) for s in subset_names(["a", "b", "c"])]
    d = t.oof.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("subset", F.explode(F.array(*[F.lit(s) for s in sets])))


@query("o6_parameter_grid", oracle="""
    SELECT t AS threshold, q AS quantity, sum(CASE WHEN l_discount > t AND l_quantity > q THEN 1 ELSE 0 END)::BIGINT AS n
    FROM lineitem, (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) a(t), (VALUES (10), (30), (45)) b(q) GROUP BY 1, 2""")
def _(t):
    from prefrank.operators.models import parameter_grid

    grid = parameter_grid(t.spark, {"threshold": [0.02, 0.05], "quantity": [10, 30, 45]})
    d = t.lineitem.crossJoin(F.broadcast(grid))
    hit = F.when((F.col("l_discount") > F.col("threshold")) & (F.col("l_quantity") > F.col("quantity")), 1).otherwise(0)
    return d.groupBy("threshold", "quantity").agg(F.sum(hit).alias("n"))


@query("o7_leaderboard_sort", uses="oof", oracle="""
    SELECT category, round(avg(true_score), 6) AS metric FROM oof GROUP BY 1 ORDER BY avg(true_score) DESC, category""")
def _(t):
    d = t.oof.groupBy("category").agg(F.avg("true_score").alias("metric")).orderBy(F.desc("metric"), "category")
    return rounded(d, "metric")


@query("o8_release_order", uses="ratings", oracle="SELECT category, item, similarity FROM ratings ORDER BY ALL")
def _(t):
    from prefrank.operators.panel import release_table

    return release_table(t.ratings, ["category", "item", "similarity"])


@query("x21_table_fingerprint", oracle="""
    WITH h AS (SELECT CAST('0x' || substr(md5(concat_ws(':', doc_id, quality, toxic)), 1, 8) AS BIGINT) AS h FROM labels)
    SELECT count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM h""")
def _(t):
    return G.table_fingerprint(t.labels)
