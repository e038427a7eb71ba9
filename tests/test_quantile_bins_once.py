"""Quantile bins make their input once, however often they read it."""

from prefrank.operators import ranking as R


def test_input_is_made_once(spark, tiny_groups):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.range(100).selectExpr("id AS item", "CAST(id % 50 AS DOUBLE) AS v").mapInPandas(count, "item long, v double")
    bins = [r["bin"] for r in R.add_quantile_bin(df, "v").collect()]
    assert sorted(bins) == sorted(1 + i // 20 for i in range(100))
    assert made.value == 100
