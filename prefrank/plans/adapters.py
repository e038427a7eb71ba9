"""Domain tables derived from the test tables, in SQL that Spark and DuckDB both read.

Scores are averages of integers (cents, percent), so both engines compute them exactly.
"""

from __future__ import annotations

import re

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()

ADAPTERS: dict[str, str] = {
    # Out-of-fold predictions: one row per item of a category.
    "oof": """
        SELECT p_brand AS category, p_partkey AS item,
               CAST(floor(avg(l_quantity) * 2) AS DOUBLE) / 2 AS true_score,
               avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS predicted_score
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        GROUP BY p_brand, p_partkey""",
    "stats_multi": """
        SELECT p_brand AS category, p_partkey AS item,
               CAST(floor(avg(l_quantity) * 2) AS DOUBLE) / 2 AS true_score,
               avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price,
               floor(avg(CAST(round(l_discount * 100) AS BIGINT)) * 4) / 4 AS discount,
               avg(CAST(round(l_tax * 100) AS BIGINT)) AS tax
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        GROUP BY p_brand, p_partkey""",
    "oof_multi": """
        SELECT 'price' AS model, category, item, true_score, price AS predicted_score FROM stats_multi
        UNION ALL
        SELECT 'discount', category, item, true_score, CAST(discount AS DOUBLE) FROM stats_multi
        UNION ALL
        SELECT 'tax', category, item, true_score,
               CASE WHEN item % 17 = 3 THEN CAST(NULL AS DOUBLE) ELSE tax END FROM stats_multi""",
    # Panel ratings 0..10: one row per respondent and item of a category.
    "ratings": """
        SELECT event_type AS category, user_id AS respondent,
               CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 6 AS item,
               CAST(least(10, floor(avg(CAST(round(value * 100) AS BIGINT)) / 1000)) AS DOUBLE) AS similarity,
               max(2024 + user_id % 3) AS year
        FROM {events}
        GROUP BY event_type, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 6""",
    "item_labels": """
        SELECT category, item,
               CASE WHEN item = 0 THEN 'animal_reference' ELSE 'plant_based' END AS product_type,
               CASE WHEN item = 1 THEN CAST(NULL AS BOOLEAN) ELSE item % 4 = 0 END AS has_meat,
               CASE WHEN item = 2 THEN CAST(NULL AS BOOLEAN) ELSE item % 5 = 3 END AS has_dairy,
               item = 0 AS is_reference
        FROM (SELECT DISTINCT category, item FROM ratings) AS u""",
    # Product rows with an ingredient list and nutrition facts.
    "products": """
        SELECT p_brand AS category, p_partkey AS item, 2023 + p_size % 4 AS year,
               concat(p_name, ', ', lower(p_type), ' (', p_name, '), water, ', p_name) AS ingredients,
               replace(concat(p_name, ' | ', lower(p_type), ' | ', p_name, ' powder | water'), '  ', ' ')
                   AS cleaned_ingredients,
               CASE WHEN p_size % 9 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_size * 10 AS DOUBLE) END AS serving_g,
               CASE WHEN p_size % 2 = 0 THEN 'milliliters' ELSE 'grams' END AS serving_unit,
               p_retailprice AS calories,
               CASE WHEN p_partkey % 5 = 0 THEN CAST(0 AS DOUBLE)
                    WHEN p_partkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE p_retailprice / 100 END AS fat_g,
               CASE WHEN p_partkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE p_retailprice END AS sodium_mg,
               CASE WHEN p_partkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_size * 130 AS DOUBLE) END AS potassium_mg,
               CASE WHEN p_partkey % 2 = 0 THEN 'panel' ELSE 'external' END AS source
        FROM {part}""",
    # Items with two vector blocks; block_a is missing for some.
    "items_vec": """
        SELECT CAST(label AS BIGINT) AS category, vec_id AS item,
               vec_id % 7 = 0 AS is_reference, embedding AS vec
        FROM {embeddings}""",
    # Class probabilities from the first five vector entries.
    "probs": """
        SELECT id, y_true, e0 / s AS p0, e1 / s AS p1, e2 / s AS p2, e3 / s AS p3, e4 / s AS p4 FROM (
          SELECT *, e0 + e1 + e2 + e3 + e4 AS s FROM (
            SELECT vec_id AS id, CAST(label % 5 AS BIGINT) AS y_true,
                   exp(CAST(5 AS DOUBLE) * CAST(element_at(embedding, 1) AS DOUBLE)) AS e0,
                   exp(CAST(5 AS DOUBLE) * CAST(element_at(embedding, 2) AS DOUBLE)) AS e1,
                   exp(CAST(5 AS DOUBLE) * CAST(element_at(embedding, 3) AS DOUBLE)) AS e2,
                   exp(CAST(5 AS DOUBLE) * CAST(element_at(embedding, 4) AS DOUBLE)) AS e3,
                   exp(CAST(5 AS DOUBLE) * CAST(element_at(embedding, 5) AS DOUBLE)) AS e4
            FROM {embeddings}) AS x) AS y""",
    # Small groups: the lines of an order are the items of a category.
    "order_items": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) AS category, CAST(l_linenumber AS BIGINT) AS item,
               max(l_quantity) AS true_score,
               CAST(max(round(l_discount * 100)) AS DOUBLE) AS predicted_score
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Judgements of item pairs, with failures.
    "judgements": """
        SELECT category, item_1, item_2, score_1, score_2,
               CASE WHEN substr(h, 32, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN '1' ELSE '2' END AS prediction,
               CASE WHEN substr(h, 31, 1) = '0' THEN 'PARSE_FAIL' WHEN substr(h, 31, 1) = '1' THEN 'NO_DATA' ELSE 'OK' END AS status,
               substr(h, 30, 1) IN ('0', '1', '2', '3') AS second_arm_flips
        FROM (SELECT a.category, a.item AS item_1, b.item AS item_2, a.true_score AS score_1, b.true_score AS score_2,
                     md5(concat_ws(':', a.category, a.item, b.item)) AS h
              FROM order_items a JOIN order_items b ON a.category = b.category AND a.item < b.item) AS j""",
    # Knowledge graph: parts are foods, suppliers are chemicals, an order line is one piece of evidence.
    "kg_entities": """
        SELECT concat('f', p_partkey) AS entity_id, 'food' AS entity_type, p_name AS common_name,
               concat('["', p_name, ' (raw)", "fresh ', p_name, '"]') AS synonyms, '{{}}' AS external_ids, '{{}}' AS attributes,
               p_partkey AS row_order
        FROM {part}
        UNION ALL
        SELECT concat('c', s_suppkey), 'chemical', lower(s_name), '[]',
               concat('{{"pubchem_compound": [', s_suppkey, ', 7], "chebi": [', s_suppkey + 1, ']}}'),
               CASE WHEN s_suppkey % 3 = 0 THEN '{{"flavor_descriptors": []}}' WHEN s_suppkey % 10 = 1 THEN 'not json'
                    ELSE '{{"flavor_descriptors": ["sweet"]}}' END,
               1000000000 + s_suppkey
        FROM {supplier}""",
    "kg_evidence": """
        SELECT concat('f', l_partkey) AS head_id, concat('c', l_suppkey) AS tail_id,
               l_quantity AS conc_value, CASE l_returnflag WHEN 'A' THEN 'mg/100g' WHEN 'N' THEN 'ions' ELSE '%' END AS conc_unit,
               CASE l_linestatus WHEN 'F' THEN 'curated' ELSE 'lit:auto' END AS source,
               CASE WHEN l_discount > 0.09 THEN CAST(NULL AS DOUBLE) ELSE l_discount * 10 END AS filter_score
        FROM {lineitem}""",
    "mentions": """
        SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('Organic Dried ', p_name) WHEN 2 THEN concat(p_name, ' Powder')
                        ELSE concat('mystery ', p_type) END AS ingredient FROM {part}
        UNION SELECT s_name FROM {supplier} WHERE s_suppkey % 5 = 0""",
    # Curated targets: a pair, a pair without compounds, a food, a food under another spelling, a chemical, an unknown name.
    "curated_names": """
        SELECT lower(concat('mystery ', p_type)) AS name,
               CASE count(*) % 3 WHEN 0 THEN concat('blend of ', lower(p_type)) WHEN 1 THEN concat('empty ', lower(p_type)) ELSE concat(min(p_name), ' Extract') END AS target
        FROM {part} GROUP BY p_type
        UNION ALL SELECT lower(p_name), CASE count(*) % 4 WHEN 0 THEN concat('blend of ', lower(min(p_type))) WHEN 1 THEN 'supplier#000000001' WHEN 2 THEN 'nothing known' ELSE max(p_name) END
        FROM {part} GROUP BY p_name HAVING min(p_partkey) % 2 = 0""",
    # Pairs of foods: called like a blend, like a food, and pairs of which nothing is known.
    "food_pairs": """
        SELECT concat('blend of ', lower(p_type)) AS pair, 0 AS place, min(p_name) AS entry FROM {part} GROUP BY p_type
        UNION ALL SELECT concat('blend of ', lower(p_type)), 1, max(p_name) FROM {part} GROUP BY p_type
        UNION ALL SELECT lower(p_name), 0, p_name FROM {part} GROUP BY p_name HAVING max(p_partkey) % 3 = 0
        UNION ALL SELECT lower(p_name), 1, concat('no ', p_name) FROM {part} GROUP BY p_name HAVING max(p_partkey) % 3 = 0
        UNION ALL SELECT lower(p_name), 2, concat('fresh ', min(p_type), ' ', p_name) FROM {part} GROUP BY p_name HAVING max(p_partkey) % 3 = 0
        UNION ALL SELECT lower(p_name), 3, concat('small ', p_name) FROM {part} GROUP BY p_name HAVING max(p_partkey) % 3 = 0
        UNION ALL SELECT lower(p_name), 4, 'blue bolt' FROM {part} GROUP BY p_name HAVING max(p_partkey) % 3 = 0
        UNION ALL SELECT concat('empty ', lower(p_type)), 0, concat('no ', p_type) FROM {part} GROUP BY p_type""",
    # Compounds of an ingredient with their vectors: ingredient = part type and size, compound = supplier.
    "compound_slice": """
        SELECT ingredient, compound, CASE WHEN compound % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE concentration END AS concentration FROM (
          SELECT concat(p_type, ' ', p_size) AS ingredient, l_suppkey AS compound, max(l_quantity) - 1 AS concentration
          FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type, p_size, l_suppkey) AS g""",
    "compound_vectors": """
        SELECT vec_id AS compound, embedding AS vec FROM {embeddings}""",
    "recipes": """
        SELECT o_orderkey AS product, pos, ingredient FROM (
          SELECT l_orderkey AS o_orderkey, l_linenumber - 1 AS pos, min(concat(p_type, ' ', p_size)) AS ingredient
          FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber) AS r""",
    "docs": """
        SELECT doc_id, source AS category, lang, text FROM {documents}""",
}


def needed(names: list[str]) -> tuple[list[str], list[str]]:
    """Adapters in dependency order, and the base tables they read."""
    order: list[str] = []
    bases: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        text = ADAPTERS[n]
        for other in ADAPTERS:
            if other != n and re.search(rf"\b{other}\b", text.replace("{" + other + "}", "")):
                visit(other)
        for b in re.findall(r"\{(\w+)\}", text):
            if b not in bases:
                bases.append(b)
        order.append(n)

    for n in names:
        visit(n)
    return order, bases
