"""Vector, feature block and centroid score queries over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.functions.vectors import cosine_distance, doubles, euclidean, l2_normalised
from prefrank.operators import centroid as D, features as E
from prefrank.operators import preparation as FT
from prefrank.plans.registry import query

LONG = """
    WITH x AS (SELECT category, item, is_reference, generate_subscripts(vec, 1) - 1 AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM items_vec)
"""


def _values(d, *keep, vec="vec"):
    d = d.select(*keep, F.posexplode(vec).alias("pos", "value"))
    return d.select(*keep, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def _blocks(t):
    """a: first 32 entries; b: last 32, missing for every eleventh item; c: entries 1-8 with unknown entries."""
    v = doubles(F.col("vec"))
    return t.items_vec.select(
        "category", "item", "is_reference", F.slice(v, 1, 32).alias("a"),
        F.when(F.col("item") % 11 != 0, F.slice(v, 33, 32)).alias("b"))


@query("a14_group_mean_vector", uses="items_vec", oracle=LONG + """
    SELECT category, pos, round(avg(x), 6) AS value FROM x GROUP BY 1, 2""")
def _(t):
    return _values(E.pooled(t.items_vec, ["category"], "vec"), "category")


@query("a14_group_max_sum_vector", uses="items_vec", oracle=LONG + """
    SELECT category, pos, round(max(x), 6) AS top, round(sum(x), 6) AS total FROM x GROUP BY 1, 2""")
def _(t):
    a = _values(E.pooled(t.items_vec, ["category"], "vec", "max"), "category").withColumnRenamed("value", "top")
    b = _values(E.pooled(t.items_vec, ["category"], "vec", "sum"), "category").withColumnRenamed("value", "total")
    return a.join(b, ["category", "pos"])


@query("x13_vector_distances", uses="items_vec", oracle=LONG + """,
    c AS (SELECT category, pos, avg(x) AS c FROM x WHERE is_reference GROUP BY 1, 2)
    SELECT item, round(1 - sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)), 6) AS cosine,
           round(sqrt(sum((x - c) * (x - c))), 6) AS euclidean FROM x JOIN c USING (category, pos) GROUP BY 1""")
def _(t):
    c = E.pooled(t.items_vec.filter("is_reference"), ["category"], "vec", out="c")
    v = doubles(F.col("vec"))
    return t.items_vec.join(F.broadcast(c), "category").select(
        "item", F.round(cosine_distance(v, F.col("c")), 6).alias("cosine"), F.round(euclidean(v, F.col("c")), 6).alias("euclidean"))


@query("x14_l2_normalise", uses="items_vec", oracle="""
    WITH y AS (SELECT item, generate_subscripts(vec, 1) - 1 AS pos, CAST(unnest(vec) AS DOUBLE) * (1 + item % 3) AS x FROM items_vec)
    SELECT item, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY item)), 6) AS value FROM y""")
def _(t):
    v = F.transform(doubles(F.col("vec")), lambda x: x * (F.lit(1) + F.col("item") % 3))
    return _values(t.items_vec.select("item", l2_normalised(v).alias("vec")), "item")


@query("j7_item_to_centroid", uses="items_vec", oracle=LONG + """,
    c AS (SELECT category, pos, avg(x) AS c FROM x WHERE is_reference GROUP BY 1, 2)
    SELECT category, item, round(sqrt(sum((x - c) * (x - c))), 6) AS distance FROM x JOIN c USING (category, pos) GROUP BY 1, 2""")
def _(t):
    b = E.long_blocks(t.items_vec, ["vec"], ["category", "item", "is_reference"])
    return D.centroid_distances(b, "euclidean", "none").select("category", "item", F.round("distance", 6).alias("distance"))


@query("p1_complete_rows", uses="items_vec", oracle="""
    SELECT item, CAST(len(vec) AS BIGINT) AS dims, round(list_sum(list_transform(vec, lambda v: CAST(v AS DOUBLE))), 6) AS total
    FROM items_vec WHERE item % 11 <> 0""")
def _(t):
    d = E.complete_rows(_blocks(t), ["a", "b"])
    return d.select("item", F.size("vec").cast("long").alias("dims"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


KNN = LONG + """,
    q AS (SELECT * FROM x WHERE pos < 32 AND item % 11 = 0), r AS (SELECT * FROM x WHERE pos < 32 AND item % 11 <> 0),
    d AS (SELECT q.category, q.item, r.item AS nb, 1 - sum(q.x * r.x) / sqrt(sum(q.x * q.x)) / sqrt(sum(r.x * r.x)) AS dist
          FROM q JOIN r ON q.category = r.category AND q.pos = r.pos GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY dist, nb) AS rank FROM d)
"""


@query("j8_nearest_neighbours", uses="items_vec", oracle=KNN + """
    SELECT item, nb AS neighbour, rank, round(dist, 6) AS distance FROM k WHERE rank <= 5""")
def _(t):
    d = _blocks(t)
    near = E.nearest_neighbours(d.filter("b IS NULL"), d.filter("b IS NOT NULL"), "category", "item", "a", 5)
    return near.select("item", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("p2_knn_imputation", uses="items_vec", oracle=KNN + """
    SELECT k.item, x.pos - 32 AS pos, round(avg(x.x), 6) AS value FROM k JOIN x ON x.item = k.nb AND x.pos >= 32
    WHERE rank <= 5 GROUP BY 1, 2 UNION ALL SELECT item, pos - 32, round(x, 6) FROM x WHERE pos >= 32 AND item % 11 <> 0""")
def _(t):
    return _values(E.knn_imputed(_blocks(t), ["a", "b"], 5), "item", vec="b")


@query("p3_one_block_imputation", uses="items_vec", oracle=KNN.replace("FROM items_vec", "FROM items_vec WHERE NOT is_reference") + """
    SELECT k.item, x.pos - 32 AS pos, round(avg(x.x), 6) AS value FROM k JOIN x ON x.item = k.nb AND x.pos >= 32
    WHERE rank <= 5 GROUP BY 1, 2 UNION ALL SELECT item, pos - 32, round(x, 6) FROM x WHERE pos >= 32 AND item % 11 <> 0""")
def _(t):
    return _values(E.knn_imputed(_blocks(t).filter("NOT is_reference"), ["a", "b"], 5, only=["b"]), "item", vec="b")


@query("p4_column_mean_imputation", uses="items_vec", oracle=LONG + """,
    g AS (SELECT item, pos, CASE WHEN (item + pos) % 5 = 0 THEN NULL ELSE x END AS x FROM x)
    SELECT item, pos, round(coalesce(x, avg(x) OVER (PARTITION BY pos)), 6) AS value FROM g""")
def _(t):
    v = F.transform(doubles(F.col("vec")), lambda x, i: F.when((F.col("item") + i) % 5 != 0, x))
    return _values(E.impute_column_means(t.items_vec.select("item", v.alias("vec")), [], "vec"), "item")


@query("p5_standard_scaler", uses="items_vec", oracle=LONG + """
    SELECT item, pos, round((x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos), 6) AS value FROM x""")
def _(t):
    return _values(E.scaled(t.items_vec.withColumn("vec", doubles(F.col("vec"))), [], "vec"), "item")


@query("p5_minmax_scaler", uses="items_vec", oracle=LONG + """
    SELECT item, pos, round((x - min(x) OVER (PARTITION BY pos)) / (max(x) OVER (PARTITION BY pos) - min(x) OVER (PARTITION BY pos)), 6) AS value FROM x""")
def _(t):
    return _values(E.scaled(t.items_vec.withColumn("vec", doubles(F.col("vec"))), [], "vec", "minmax"), "item")


@query("p5_robust_scaler", uses="items_vec", oracle=LONG + """,
    q AS (SELECT pos, quantile_cont(x, 0.25) AS a, median(x) AS m, quantile_cont(x, 0.75) AS b FROM x GROUP BY 1)
    SELECT item, pos, round((x - m) / (b - a), 6) AS value FROM x JOIN q USING (pos)""")
def _(t):
    return _values(E.scaled(t.items_vec.withColumn("vec", doubles(F.col("vec"))), [], "vec", "robust"), "item")


OTHER_FOLDS = LONG + """,
    fx AS (SELECT x.*, item % 5 AS fold FROM x),
    fs AS (SELECT fold, pos, count(x) AS n, sum(x) AS s, sum(x * x) AS ss FROM fx GROUP BY 1, 2),
    ot AS (SELECT a.fold, a.pos, sum(b.n) AS n, sum(b.s) AS s, sum(b.ss) AS ss FROM fs a JOIN fs b ON a.pos = b.pos AND a.fold <> b.fold GROUP BY 1, 2)
"""


def _folds(t):
    return t.items_vec.select("item", (F.col("item") % 5).alias("fold"), doubles(F.col("vec")).alias("vec"))


@query("p4_held_out_imputation", uses="items_vec", oracle=LONG + """,
    fx AS (SELECT item, item % 5 AS fold, pos, CASE WHEN (item + pos) % 7 <> 0 THEN x END AS x FROM x),
    fs AS (SELECT fold, pos, count(x) AS n, sum(x) AS s FROM fx GROUP BY 1, 2),
    ot AS (SELECT a.fold, a.pos, sum(b.n) AS n, sum(b.s) AS s FROM fs a JOIN fs b ON a.pos = b.pos AND a.fold <> b.fold GROUP BY 1, 2)
    SELECT item, fx.pos, round(coalesce(x, s / n), 6) AS value FROM fx JOIN ot USING (fold, pos)""")
def _(t):
    v = F.transform("vec", lambda x, i: F.when((F.col("item") + i) % 7 != 0, x))
    return _values(FT.impute_held_out(_folds(t).withColumn("vec", v), "fold", "vec"), "item")


@query("p5_held_out_scaler", uses="items_vec", oracle=OTHER_FOLDS + """
    SELECT item, fx.pos, round((x - ot.s / ot.n) / sqrt(ot.ss / ot.n - (ot.s / ot.n) * (ot.s / ot.n)), 6) AS value FROM fx JOIN ot USING (fold, pos)""")
def _(t):
    d = _folds(t)
    states = FT.fold_states(d, "fold", "vec", FT.Plan(wide=1000))
    return _values(FT.transform(d, states, "vec", ["fold"]), "item")


@query("p5_train_test_scaler", uses="items_vec", oracle=LONG + """,
    q AS (SELECT pos, quantile_cont(x, 0.25) AS a, median(x) AS m, quantile_cont(x, 0.75) AS b FROM x WHERE item % 4 <> 0 GROUP BY 1)
    SELECT item, pos, round((x - m) / (b - a), 6) AS value FROM x JOIN q USING (pos) WHERE item % 4 = 0""")
def _(t):
    d = _folds(t)
    state = FT.fit(d.where("item % 4 <> 0"), "vec", FT.Plan("robust", wide=1000))
    return _values(FT.transform(d.where("item % 4 = 0"), state, "vec"), "item")


@query("p6_held_out_projection")
def _(t):
    d = _folds(t)
    return FT.transform(d, FT.fold_states(d, "fold", "vec"), "vec", ["fold"]).select("item", "fold", F.transform("vec", lambda x: F.round(x, 6)).alias("components"))


@query("p6_leave_one_out_projection")
def _(t):
    return FT.leave_one_out(_folds(t), "vec").select("item", F.transform("vec", lambda x: F.round(x, 6)).alias("components"))


@query("p7_held_out_projection_then_scale")
def _(t):
    d = _folds(t)
    states = FT.fold_states(d, "fold", "vec", FT.Plan(k=20, scale_last=True))
    return FT.transform(d, states, "vec", ["fold"]).select("item", "fold", F.transform("vec", lambda x: F.round(x, 6)).alias("components"))


@query("p6_scaled_projection")
def _(t):
    d = E.scaled_and_projected(_blocks(t), ["a"], variance=0.95)
    return d.select("item", F.size("a").alias("components"), F.round(F.abs(F.col("a")[0]), 6).alias("first"))


@query("p7_projection_then_scale")
def _(t):
    d = E.scaled(E.projected(_blocks(t), "a", None, 8, "p"), [], "p")
    return d.select("item", F.round(F.abs(F.col("p")[0]), 6).alias("first"))


BLOCKS = LONG + """,
    bx AS (SELECT *, CASE WHEN pos < 32 THEN 'a' ELSE 'b' END AS block FROM x WHERE pos < 32 OR item % 11 <> 0),
    z AS (SELECT block, category, item, is_reference, pos, (x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos) AS z FROM bx),
    c AS (SELECT block, category, pos, avg(z) AS c FROM z WHERE is_reference GROUP BY 1, 2, 3),
    dd AS (SELECT block, category, item, 1 - sum(z * c) / sqrt(sum(z * z)) / sqrt(sum(c * c)) AS dist,
           sqrt(sum((z - c) * (z - c))) AS dist2 FROM z JOIN c USING (block, category, pos) GROUP BY 1, 2, 3),
    nn AS (SELECT *, rank() OVER (PARTITION BY block, category ORDER BY dist) / (count(*) OVER (PARTITION BY block, category) + 1) AS nr,
           (dist2 - min(dist2) OVER (PARTITION BY block)) / (max(dist2) OVER (PARTITION BY block) - min(dist2) OVER (PARTITION BY block)) AS nm FROM dd)
"""


def _dist(t, metric="cosine"):
    return D.centroid_distances(E.long_blocks(_blocks(t), ["a", "b"], ["category", "item", "is_reference"]), metric)


@query("d1_centroid_score", uses="items_vec", oracle=BLOCKS + """
    SELECT category, item, round(-sum(nr * CASE WHEN block = 'a' THEN 1 ELSE 2 END) / sum(CASE WHEN block = 'a' THEN 1 ELSE 2 END), 6) AS score
    FROM nn GROUP BY 1, 2""")
def _(t):
    d = D.combined(D.normalised(_dist(t)), t.items_vec, {"a": 1.0, "b": 2.0})
    return d.select("category", "item", F.round("score", 6).alias("score"))


@query("d1_centroid_score_minmax_nan", uses="items_vec", oracle=BLOCKS + """
    SELECT category, item, CASE WHEN count(*) = 2 THEN round(-avg(nm), 6) END AS score FROM nn GROUP BY 1, 2""")
def _(t):
    d = D.combined(D.normalised(_dist(t, "euclidean"), "minmax"), t.items_vec, {"a": 1.0, "b": 1.0}, "nan")
    return d.select("category", "item", F.round("score", 6).alias("score"))


@query("d2_category_group_blocks", uses="items_vec", oracle=LONG + """,
    bx AS (SELECT *, CASE WHEN category < 4 THEN 'low' ELSE 'high' END AS block FROM x WHERE pos < 32),
    z AS (SELECT block, category, item, is_reference, pos, (x - avg(x) OVER (PARTITION BY block, pos)) / stddev_pop(x) OVER (PARTITION BY block, pos) AS z FROM bx),
    c AS (SELECT block, category, pos, avg(z) AS c FROM z WHERE is_reference GROUP BY 1, 2, 3)
    SELECT block, category, item, round(1 - sum(z * c) / sqrt(sum(z * z)) / sqrt(sum(c * c)), 6) AS distance
    FROM z JOIN c USING (block, category, pos) GROUP BY 1, 2, 3""")
def _(t):
    b = _blocks(t).select("category", "item", "is_reference",
                          F.when(F.col("category") < 4, "low").otherwise("high").alias("block"), F.col("a").alias("vec"))
    return D.centroid_distances(b).select("block", "category", "item", F.round("distance", 6).alias("distance"))


@query("d3_subset_sweep", uses="items_vec", oracle=BLOCKS + """,
    s AS (SELECT * FROM (VALUES ('a', 'a'), ('b', 'b'), ('ab', 'a'), ('ab', 'b')) v(subset, block))
    SELECT subset, category, item, round(-avg(nr), 6) AS score FROM nn JOIN s USING (block) GROUP BY 1, 2, 3""")
def _(t):
    d = D.subset_sweep(D.normalised(_dist(t)), ["a", "b"])
    return d.select("subset", "category", "item", F.round("score", 6).alias("score"))


@query("e11_block_coverage", uses="items_vec", oracle="""
    SELECT count(*) AS items, CAST(sum(CASE WHEN item % 11 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS complete, CAST(0 AS BIGINT) AS missing_a,
           CAST(sum(CASE WHEN item % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_b FROM items_vec""")
def _(t):
    return E.coverage(_blocks(t), ["a", "b"])
