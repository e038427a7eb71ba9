"""Groups with a null key give the same results however large a group may be."""

import pytest
from pyspark.sql import functions as F

from prefrank.operators import conform, metrics, ranking, resample
from prefrank.operators.skew import rank_stats, row_index


@pytest.fixture(scope="module")
def scores(spark):
    half = F.when(F.col("id") % 2 == 0, "a")
    return spark.range(200).select(half.alias("category"), F.col("id").alias("item"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 23).cast("double")).alias("true_score"),
                                   F.when(F.col("id") % 13 > 0, (F.col("id") * 53 % 31).cast("double")).alias("predicted_score"), F.lit("m").alias("model")).cache()


def results(df):
    known = df.where("true_score IS NOT NULL")
    return {
        "ranks": rank_stats(df, ["category"], "true_score").select("category", "item", "_rank", "_ties", "_n"),
        "rows": row_index(df, ["category"], "item", "place"),
        "quantiles": conform.quantiles(df, ["category"], "true_score", [0.1, 0.5, 0.75]),
        "average": ranking.add_average_rank(df, ["category"], "predicted_score", "rank"),
        "accuracy": metrics.pairwise_accuracy(df, ["category"]),
        "metrics": metrics.category_metrics(df),
        "jackknife": resample.jackknife_accuracy(known),
        "bootstrap": resample.bootstrap_accuracy(known, 5, 3, per_stratum=True),
    }


def canonical(df):
    return sorted(repr({k: [round(x, 9) for x in v] if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())}) for r in df.collect())


def test_null_groups_do_not_depend_on_size(spark, scores):
    small = {k: canonical(v) for k, v in results(scores).items()}
    spark.conf.set("spark.prefrank.groupRows", "40")
    try:
        hot = {k: canonical(v) for k, v in results(scores).items()}
    finally:
        spark.conf.unset("spark.prefrank.groupRows")
    for name in small:
        assert small[name] == hot[name], name


def test_null_group_equals_named_group(scores):
    named = scores.withColumn("category", F.coalesce("category", F.lit("none")))
    for how in (metrics.pairwise_accuracy, metrics.kendall_tau, metrics.spearman, metrics.recall_at):
        back = how(named, ["category"]).withColumn("category", F.when(F.col("category") != "none", F.col("category")))
        assert canonical(how(scores, ["category"])) == canonical(back)
