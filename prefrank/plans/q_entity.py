"""Knowledge graph and pooling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.functions import text as X
from prefrank.functions.numeric import log_weight
from prefrank.operators import entity as E
from prefrank.plans.q_conform import VARIANTS, _bare_sql
from prefrank.plans.registry import query
from prefrank.session import cut_lineage


def rounded(d, *cols):
    return d.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in d.columns])


def _values(d, *keep):
    d = d.select(*keep, F.posexplode("vec").alias("pos", "value"))
    return d.select(*keep, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


ALIAS = f"""
    WITH b AS (SELECT entity_type, entity_id, row_order, 2 AS pos, common_name AS raw FROM kg_entities
      UNION ALL SELECT entity_type, entity_id, row_order, 0, concat(common_name, ' (raw)') FROM kg_entities WHERE entity_type = 'food'
      UNION ALL SELECT entity_type, entity_id, row_order, 1, concat('fresh ', common_name) FROM kg_entities WHERE entity_type = 'food'),
    s AS (SELECT DISTINCT lower(trim(raw)) AS n FROM b),
    vr AS (SELECT DISTINCT n, v FROM ({VARIANTS}) WHERE v <> ''),
    al AS (SELECT entity_type, lower(trim(raw)) AS name, entity_id, 0 AS phase, row_order, pos FROM b
      UNION ALL SELECT entity_type, v, entity_id, 1, row_order, pos FROM b JOIN vr ON n = lower(trim(raw))),
    ix AS (SELECT entity_type, name, arg_min(entity_id, (phase, row_order, pos)) AS entity_id FROM al GROUP BY 1, 2),
    tr AS (SELECT ingredient, 1 AS tier, 20 AS step, 'food' AS entity_type, lower(trim(ingredient)) AS name FROM mentions
      UNION ALL SELECT ingredient, 2, 21, 'food', {_bare_sql('ingredient')} FROM mentions
      UNION ALL SELECT ingredient, 2, 23, 'food', lower(list_last(string_split(ingredient, ' '))) FROM mentions
      UNION ALL SELECT ingredient, 3, 29, 'chemical', lower(trim(ingredient)) FROM mentions),
    mp AS (SELECT ingredient, arg_min(entity_id, step) AS entity_id, CAST(arg_min(tier, step) AS BIGINT) AS tier FROM tr JOIN ix USING (entity_type, name) GROUP BY 1)
"""


def _mapped(t):
    return E.mapped_ingredients(t.mentions, E.alias_index(t.kg_entities))


@query("s5_json_columns", oracle="""
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    parsed = X.parse_json_or(F.when(F.col("event_id") % 10 == 0, None).otherwise(raw), "k bigint", F.struct(F.lit(-1).cast("long").alias("k")))
    return t.events.select("event_id", parsed["k"].alias("k"))


@query("e1_alias_index", uses="kg_entities mentions", oracle=ALIAS + "SELECT * FROM ix")
def _(t):
    return E.alias_index(t.kg_entities)


@query("e2_tiered_match", uses="kg_entities mentions", oracle=ALIAS + "SELECT * FROM mp")
def _(t):
    return _mapped(t)


PAIRS = ALIAS.rstrip() + f""",
    kt AS (SELECT DISTINCT ingredient, target FROM mentions JOIN curated_names ON name = lower(trim(ingredient))),
    al2 AS (SELECT ingredient, 0 AS step, 'food' AS entity_type, lower(trim(target)) AS name FROM kt
      UNION ALL SELECT ingredient, 1, 'food', {_bare_sql('target')} FROM kt
      UNION ALL SELECT ingredient, 3, 'food', lower(list_last(string_split(target, ' '))) FROM kt
      UNION ALL SELECT ingredient, 9, 'chemical', lower(trim(target)) FROM kt),
    m2 AS (SELECT ingredient, arg_min(entity_id, step) AS entity_id, arg_min(tier, step) AS tier FROM (
      SELECT ingredient, step, entity_id, 0 AS tier FROM al2 JOIN ix USING (entity_type, name)
      UNION ALL SELECT ingredient, step, entity_id, tier FROM tr JOIN ix USING (entity_type, name)) GROUP BY 1),
    eg AS (SELECT head_id, tail_id, avg(CASE WHEN conc_unit = 'mg/100g' THEN conc_value END) AS concentration FROM kg_evidence GROUP BY 1, 2),
    pc AS (SELECT pair, tail_id AS compound, max(CASE WHEN place = 0 THEN concentration END) AS concentration FROM food_pairs
      JOIN ix ON entity_type = 'food' AND name = lower(trim(entry)) JOIN eg ON head_id = entity_id GROUP BY 1, 2),
    lv AS (SELECT pair, string_agg(entry, '+' ORDER BY place) AS label FROM food_pairs WHERE pair IN (SELECT pair FROM pc) GROUP BY 1),
    rs AS (SELECT ingredient, coalesce(a.label, entity_id) AS entity_id, CAST(CASE WHEN a.label IS NOT NULL THEN 0 ELSE tier END AS BIGINT) AS tier, coalesce(a.pair, b.pair) AS pair
      FROM (SELECT DISTINCT ingredient FROM mentions) LEFT JOIN kt USING (ingredient) LEFT JOIN m2 USING (ingredient) LEFT JOIN kg_entities e USING (entity_id)
      LEFT JOIN lv a ON a.pair = target LEFT JOIN lv b ON b.pair = lower(common_name) AND tier IN (1, 2) WHERE coalesce(a.label, entity_id) IS NOT NULL)
"""


def _resolved(t):
    edges = E.edge_concentration(t.kg_evidence, ["mg/100g"])
    return E.resolved_with_pairs(t.mentions, E.alias_index(t.kg_entities), t.kg_entities, edges, t.curated_names, t.food_pairs)


@query("e2_pair_match", uses="kg_entities kg_evidence mentions curated_names food_pairs", oracle=PAIRS + "SELECT * FROM rs")
def _(t):
    return _resolved(t)[0]


@query("e3_pair_compounds", uses="kg_entities kg_evidence mentions curated_names food_pairs", oracle=PAIRS + """
    SELECT ingredient, compound, round(concentration, 6) AS concentration FROM rs JOIN pc USING (pair)
    UNION ALL SELECT ingredient, tail_id, round(concentration, 6) FROM rs JOIN eg ON head_id = entity_id WHERE pair IS NULL
    UNION ALL SELECT ingredient, entity_id, NULL FROM rs WHERE pair IS NULL AND entity_id IN (SELECT entity_id FROM kg_entities WHERE entity_type = 'chemical')""")
def _(t):
    return rounded(_resolved(t)[1], "concentration")


@query("e3_primary_fallback", oracle="""
    WITH p AS (SELECT p_type AS ingredient, l_suppkey AS compound, max(l_quantity) AS concentration FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25 GROUP BY 1, 2),
    f AS (SELECT DISTINCT p_type AS ingredient, l_suppkey AS compound FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 25)
    SELECT * FROM p UNION ALL SELECT ingredient, compound, NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ingredient = f.ingredient AND p.compound = f.compound)""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("ingredient"), F.col("l_suppkey").alias("compound"), F.col("l_quantity").alias("q"), "p_size")
    side = lambda cond: d.filter(cond).groupBy("ingredient", "compound").agg(F.max("q").alias("concentration"))
    return E.merged_compounds(side("p_size < 25"), [side("p_size >= 25")])


@query("e4_evidence_filters", uses="kg_evidence", oracle="""
    SELECT head_id, tail_id FROM kg_evidence GROUP BY 1, 2
    HAVING max(CASE WHEN source = 'lit:auto' AND coalesce(filter_score, -1) < 0.5 THEN 0 ELSE 1 END) = 1""")
def _(t):
    return E.kept_edges(t.kg_evidence, ["unknown"], "lit:", 0.5)


@query("e4_source_blacklist", uses="kg_evidence", oracle="""
    SELECT head_id, tail_id FROM kg_evidence GROUP BY 1, 2 HAVING max(CASE WHEN source = 'lit:auto' THEN 0 ELSE 1 END) = 1""")
def _(t):
    return E.kept_edges(t.kg_evidence, ["lit:auto"])


@query("e4_flavour_chemicals", uses="kg_entities", oracle="""
    SELECT entity_id FROM kg_entities WHERE entity_type = 'chemical' AND contains(attributes, 'sweet')""")
def _(t):
    return E.flavour_chemicals(t.kg_entities)


@query("e5_unit_allowlist", uses="kg_evidence", oracle="""
    SELECT head_id, tail_id, round(avg(CASE WHEN conc_unit = 'mg/100g' THEN conc_value END), 6) AS concentration FROM kg_evidence GROUP BY 1, 2""")
def _(t):
    return rounded(E.edge_concentration(t.kg_evidence, ["mg/100g"]), "concentration")


@query("a6_quality_weighted_mean", uses="kg_evidence", oracle="""
    WITH q AS (SELECT *, CASE WHEN source = 'curated' THEN 1 ELSE coalesce(filter_score, 0) END AS w FROM kg_evidence)
    SELECT head_id, tail_id, round(sum(CASE WHEN w > 0 THEN conc_value * w END) / sum(CASE WHEN w > 0 THEN w END), 6) AS concentration FROM q GROUP BY 1, 2""")
def _(t):
    return rounded(E.edge_concentration(t.kg_evidence, quality=True), "concentration")


@query("e6_external_units", uses="kg_evidence", oracle="""
    SELECT head_id, count(*) AS n, round(sum(CASE WHEN conc_unit = '%' THEN conc_value * 1000 ELSE conc_value END), 6) AS total
    FROM kg_evidence WHERE conc_unit IN ('%', 'mg/100g') AND conc_value > 0 GROUP BY 1""")
def _(t):
    d = t.kg_evidence.select("head_id", F.col("conc_value").alias("amount"), F.col("conc_unit").alias("unit"))
    return rounded(E.external_concentration(d).groupBy("head_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")), "total")


CONTENT = """
    WITH ct AS (SELECT p_type AS food, concat('s', l_suppkey % 20) AS smiles, l_suppkey AS source_id, l_quantity AS amount FROM lineitem JOIN part ON l_partkey = p_partkey),
    pf AS (SELECT food, smiles, max(amount) AS amount FROM ct GROUP BY 1, 2),
    md AS (SELECT smiles, arg_max(m, source_id) AS median FROM (SELECT smiles, source_id, median(amount) AS m FROM ct GROUP BY 1, 2) GROUP BY 1)
"""


def _content(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.select(F.col("p_type").alias("food"), F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("smiles"),
                    F.col("l_suppkey").alias("source_id"), F.col("l_quantity").alias("amount"))


@query("a5_max_and_median", oracle=CONTENT + """
    SELECT pf.food, pf.smiles, pf.amount, round(md.median, 6) AS median FROM pf JOIN md ON md.smiles = pf.smiles""")
def _(t):
    pf, md = E.external_index(_content(t))
    return rounded(pf.join(md, "smiles").select("food", "smiles", "amount", "median"), "median")


@query("j11_filled_concentration", oracle=CONTENT + """,
    e AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS food, concat('s', p_partkey % 20) AS smiles,
      CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS c FROM part)
    SELECT p_partkey, round(coalesce(c, a.amount, b.amount, median), 6) AS concentration FROM e
    LEFT JOIN (SELECT * FROM pf WHERE food = 'PROMO') a ON e.food = 'small' AND a.smiles = e.smiles
    LEFT JOIN pf b ON b.food = e.food AND b.smiles = e.smiles LEFT JOIN md ON md.smiles = e.smiles""")
def _(t):
    pf, md = E.external_index(_content(t))
    k = F.col("p_partkey")
    edges = t.part.select("p_partkey", F.when(k % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type")).alias("food"),
                          F.concat(F.lit("s"), (k % 20).cast("string")).alias("smiles"), F.when(k % 3 == 0, F.col("p_retailprice")).alias("concentration"))
    alias = t.part.filter("p_type = 'SMALL'").select(F.lower("p_type").alias("food"), F.lit("PROMO").alias("external_food")).distinct()
    return rounded(E.filled_concentration(edges, pf, md, alias).select("p_partkey", "concentration"), "concentration")


def _smiles(t):
    first = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))).alias("smiles"))
    second = t.supplier.filter("s_suppkey % 3 > 0").select((F.col("s_suppkey") + 1).alias("id"), F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("smiles"))
    return E.resolved_smiles(t.kg_entities.filter("entity_type = 'chemical'"), first, second)


SMI = "SELECT concat('c', s_suppkey) AS entity_id, CASE WHEN s_suppkey % 4 > 0 THEN concat('P', s_suppkey) ELSE concat('B', s_suppkey) END AS smiles FROM supplier WHERE s_suppkey % 4 > 0 OR s_suppkey % 3 > 0"


@query("j10_priority_lookup", oracle=SMI)
def _(t):
    return _smiles(t)


@query("j9_compound_chain", uses="kg_entities kg_evidence mentions", oracle=ALIAS + f""", sm AS ({SMI}),
    ec AS (SELECT head_id, tail_id, avg(conc_value) AS c FROM kg_evidence GROUP BY 1, 2)
    SELECT ingredient, tail_id AS compound, smiles, round(c, 6) AS concentration FROM mp JOIN ec ON head_id = mp.entity_id JOIN sm ON sm.entity_id = tail_id WHERE tier < 3
    UNION ALL SELECT ingredient, mp.entity_id, smiles, NULL FROM mp JOIN sm ON sm.entity_id = mp.entity_id WHERE tier = 3""")
def _(t):
    return rounded(E.compound_rows(_mapped(t), E.edge_concentration(t.kg_evidence), _smiles(t)), "concentration")


@query("e10_compound_slice", uses="kg_entities kg_evidence mentions", oracle=ALIAS + f""", sm AS ({SMI}),
    ok AS (SELECT head_id, tail_id FROM kg_evidence GROUP BY 1, 2 HAVING max(CASE WHEN source = 'lit:auto' THEN 0 ELSE 1 END) = 1),
    ec AS (SELECT head_id, tail_id, avg(CASE WHEN conc_unit = 'mg/100g' THEN conc_value END) AS c FROM kg_evidence GROUP BY 1, 2)
    SELECT ingredient, tail_id AS compound, smiles, round(c, 6) AS concentration FROM mp JOIN ec ON head_id = mp.entity_id JOIN ok USING (head_id, tail_id) JOIN sm ON sm.entity_id = tail_id WHERE tier < 3
    UNION ALL SELECT ingredient, mp.entity_id, smiles, NULL FROM mp JOIN sm ON sm.entity_id = mp.entity_id WHERE tier = 3""")
def _(t):
    mapped = cut_lineage(_mapped(t))
    evidence = E.edges_of(t.kg_evidence, mapped.filter("tier < 3"), "entity_id")
    edges = E.edge_concentration(evidence, ["mg/100g"], kept=E.accepted(["lit:auto"]))
    return rounded(E.compound_rows(mapped, edges, _smiles(t)), "concentration")


CV = """
    WITH cv AS (SELECT ingredient, compound, concentration, pos, CAST(vec[pos + 1] AS DOUBLE) AS x FROM compound_slice JOIN compound_vectors USING (compound), range(64) p(pos)),
"""
POOL_KEYS = "SELECT ingredient, pos, round({e}, 6) AS value FROM {t} GROUP BY 1, 2"


def _pool(t, how, **kw):
    return _values(E.ingredient_vectors(t.compound_slice, t.compound_vectors, how, **kw), "ingredient")


def _pool_query(name, how, expr, weight="1", table="cv", extra="", **kw):
    sql = CV + f"w AS (SELECT *, {weight} AS w FROM cv){extra} " + POOL_KEYS.format(e=expr, t=table)

    @query(name, uses="compound_slice compound_vectors", oracle=sql)
    def _(t):
        return _pool(t, how, **kw)


TOP = ", tp AS (SELECT *, row_number() OVER (PARTITION BY ingredient, pos ORDER BY {o}, compound) AS r FROM cv), t3 AS (SELECT * FROM tp WHERE r <= 3)"
_pool_query("e7_mean_pooling", "mean", "avg(x)")
_pool_query("e7_max_pooling", "max", "max(x)")
_pool_query("e7_linear_pooling", "linear", "CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE avg(x) END",
            "CASE WHEN concentration > 0 THEN concentration ELSE 0 END", "w")
_pool_query("e7_log_pooling", "log", "sum(w * x) / sum(w)", "ln(1 + CASE WHEN concentration > 0 THEN concentration ELSE 0 END) + 1e-6", "w")
_pool_query("e7_top3_pooling", "top3", "avg(x)", table="t3", extra=TOP.format(o="CASE WHEN concentration > 0 THEN concentration ELSE 0 END DESC"))
_pool_query("e7b_linear_pooling", "linear", "sum(w * x) / sum(w)", "CASE WHEN concentration > 0 THEN concentration ELSE 1 END", "w", zero_shot=True)
_pool_query("e7b_log_pooling", "log", "sum(w * x) / sum(w)",
            "greatest(CASE WHEN concentration > 0 THEN ln(1 + concentration) ELSE 0 END, 1e-6)", "w", zero_shot=True)
_pool_query("e7b_top3_pooling", "top3", "avg(x)", table="t3", extra=TOP.format(o="concentration DESC NULLS LAST"), zero_shot=True)

IV = CV + """iv AS (SELECT ingredient, pos AS d, avg(x) AS x FROM cv GROUP BY 1, 2),
    rp AS (SELECT product, ingredient, min(pos) AS p FROM recipes GROUP BY 1, 2), ri AS (SELECT * FROM rp JOIN iv USING (ingredient)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY product, d ORDER BY p, ingredient) AS r FROM ri)
"""


def _ingredients(t):
    return E.ingredient_vectors(t.compound_slice, t.compound_vectors, "mean")


def _product_query(name, how, expr, where=""):
    @query(name, uses="compound_slice compound_vectors recipes",
           oracle=IV + f"SELECT product, d AS pos, round({expr}, 6) AS value FROM rk {where} GROUP BY 1, 2")
    def _(t):
        return _values(E.product_vectors(t.recipes, _ingredients(t), how), "product")


_product_query("e8_weighted_products", "weighted", "sum(x / (p + 1)) / sum(1.0 / (p + 1))")
_product_query("e8_top3_products", "top3", "avg(x)", "WHERE r <= 3")
_product_query("e8b_sum_products", "sum", "sum(x)")
_product_query("e8b_max_products", "max", "max(x)")
_product_query("e8b_mean_products", "mean", "avg(x)")


@query("e9_description_pooling", uses="compound_slice compound_vectors recipes", oracle=IV + """,
    r2 AS (SELECT product, recipes.pos AS p, d, x, row_number() OVER (PARTITION BY product, d ORDER BY recipes.pos) AS r FROM recipes JOIN iv USING (ingredient)),
    m AS (SELECT product, d, sum(x / r) / sum(1.0 / r) AS m FROM r2 GROUP BY 1, 2)
    SELECT product, d AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY product)), 6) AS value FROM m""")
def _(t):
    return _values(E.described_vectors(t.recipes, _ingredients(t)), "product")


@query("e11_match_coverage", uses="compound_slice recipes", oracle="""
    SELECT product, count(*) AS listed, count(s.ingredient) AS matched FROM recipes r
    LEFT JOIN (SELECT DISTINCT ingredient FROM compound_slice) s ON s.ingredient = r.ingredient GROUP BY 1""")
def _(t):
    return E.match_coverage(t.recipes, t.compound_slice)


@query("e12_slice_coverage", uses="compound_slice compound_vectors", oracle="""
    WITH w AS (SELECT DISTINCT compound * 7 AS compound FROM compound_slice)
    SELECT (SELECT count(*) FROM compound_vectors v WHERE EXISTS (SELECT 1 FROM w WHERE w.compound = v.compound)) AS kept,
      (SELECT count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM compound_vectors v WHERE w.compound = v.compound)) AS uncovered""")
def _(t):
    need = t.compound_slice.select((F.col("compound") * 7).alias("compound"))
    kept, gone = E.slice_coverage(need, t.compound_vectors, "compound")
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(gone.agg(F.count(F.lit(1)).alias("uncovered")))


@query("x15_log_weight", uses="compound_slice", oracle="""
    SELECT ingredient, compound, round(ln(1 + greatest(coalesce(concentration, 0), 0)) + 1e-6, 9) AS w FROM compound_slice""")
def _(t):
    return t.compound_slice.select("ingredient", "compound", F.round(log_weight(F.col("concentration")), 9).alias("w"))


@query("a19_keys_per_category", uses="products", oracle="""
    SELECT category, position, item FROM (SELECT category, item, row_number() OVER (PARTITION BY category ORDER BY item) - 1 AS position FROM products)""")
def _(t):
    from prefrank.operators.skew import row_index

    return row_index(t.products.select("category", "item"), ["category"], "item", "position")
