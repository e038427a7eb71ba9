"""Positions in the canonical order are unique, also of equal rows."""

from pyspark.sql import functions as F

import prefrank.plans  # noqa: F401
from prefrank.plans.registry import QUERIES


def test_canonical_order_counts_equal_rows_on(spark, tmp_path):
    lines = spark.range(60).select((F.col("id") % 20).alias("l_partkey"), F.lit(2.0).alias("l_quantity"), (F.col("id") % 20 % 4 * 1.5).alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), F.col("id") % 2).alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["w6_canonical_order"](spark, str(tmp_path)).collect()
    assert sorted(r["pos"] for r in got) == list(range(20))
    by_pos = [(r["category"], r["true_score"], r["predicted_score"]) for r in sorted(got, key=lambda r: r["pos"])]
    assert by_pos == sorted(by_pos)
