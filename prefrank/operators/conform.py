"""Filters, key-based selection, grouped statistics and quantiles of item and rating tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefrank.functions.numeric import round_half_even
from prefrank.operators.skew import broadcast_if_small, group_load, join_keys, running_total
from prefrank.session import group_rows

KEY = ["category", "item"]


def keep_years(df: DataFrame, drop_categories: Sequence, years: Sequence[int]) -> DataFrame:
    """F1"""
    return df.filter(~F.col("category").isin(list(drop_categories)) & F.col("year").isin(list(years)))


def rated_only(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """items with at least one known rating."""
    return items.join(ratings.filter(F.col("similarity").isNotNull()).select(*KEY).distinct(), KEY, "left_semi")


def latest_per_key(df: DataFrame, keys: Sequence[str], year: str, tie: str) -> DataFrame:
    """the row of the latest year, the first by `tie` among equals; no per-key sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(F.col(year), -F.col(tie))).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def is_analog(category: Column, has_meat: Column, has_dairy: Column, meat: Sequence, dairy: Sequence) -> Column:
    """unknown flags count as analog."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return ~((category.isin(list(meat)) & yes(has_meat)) | (category.isin(list(dairy)) & yes(has_dairy)))


def without_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """F5"""
    return df.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def capped(c: Column, cap: float) -> Column:
    """values above the cap become unknown."""
    return F.when(~(c > cap), c)


def to_grams(amount: Column, unit: Column, factor: float = 1.03) -> Column:
    """F8: millilitres to grams, rounded half to even at one decimal."""
    return F.when(unit == "milliliters", round_half_even(amount * F.lit(factor), 1)).otherwise(amount)


def complete_models(df: DataFrame, at_least: int = 20) -> DataFrame:
    """drop rows with unknown scores, then models with too few rows."""
    d = df.dropna(subset=["true_score", "predicted_score"])
    ok = d.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return d.join(broadcast_if_small(ok.select("model")), ["model"], "left_semi")


def big_groups(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """F12"""
    ok = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return df.join(ok.select(*keys), list(keys), "left_semi")


def rating_stats(ratings: DataFrame, keys: Sequence[str] = KEY, value: str = "similarity") -> DataFrame:
    """A1-A3: mean, sum, known count and sample deviation (0 for a single rating)."""
    return ratings.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count(value).alias("count"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def leave_one_out_mean(ratings: DataFrame, value: str = "similarity") -> DataFrame:
    """A4: mean of the other ratings of the same item; rows of single-rated items are left out."""
    s = ratings.groupBy(*KEY).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    return (
        ratings.join(broadcast_if_small(s), KEY).filter((F.col("_count") > 1) & F.col(value).isNotNull())
        .withColumn("loo_mean", (F.col("_sum") - F.col(value)) / (F.col("_count") - 1)).drop("_sum", "_count")
    )


def zero_profile(df: DataFrame, cols: Sequence[str], by: str = "category") -> DataFrame:
    """A10: zero rate, non-zero mean and deviation, unknown rate per category and over all (NULL key)."""
    aggs = []
    for c in cols:
        v, nz = F.col(c), F.when(F.col(c) != 0, F.col(c))
        aggs += [F.avg(F.when(v == 0, 1.0).when(v.isNotNull(), 0.0)).alias(f"{c}_zero_rate"),
                 F.avg(nz).alias(f"{c}_mean"), F.stddev_samp(nz).alias(f"{c}_std"),
                 F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias(f"{c}_null_rate")]
    return df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping_id().alias("is_total"), *aggs)


def joint_null_rate(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A11"""
    gone = F.lit(True)
    for c in cols:
        gone = gone & F.col(c).isNull()
    return df.groupBy(*keys).agg(F.avg(F.when(gone, 1.0).otherwise(0.0)).alias("joint_null_rate"))


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles by linear interpolation as an array column `q`.

    `percentile` gathers the distinct values of a group in one task, so large groups instead look
    up the two bracketing values in the running counts.
    """
    keys, probs = list(keys), list(probs)
    d = df.filter(F.col(col).isNotNull())
    _, largest = group_load(d, keys)
    if largest <= group_rows(df.sparkSession):
        return d.groupBy(*keys).agg(F.percentile(col, F.array(*[F.lit(p) for p in probs])).alias("q"))
    counts = d.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    _, distinct = group_load(counts, keys)
    cum = running_total(counts, keys, col, "_c", "_cum", distinct)
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    cum = join_keys(cum, broadcast_if_small(n), keys)
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    aggs, qs = [], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for tag, pos in (("l", F.floor(h)), ("u", F.ceil(h))):
            aggs.append(F.max(F.when((first <= pos) & (pos <= last), F.col(col))).alias(f"_{tag}{i}"))
        frac = h - F.floor(h)
        qs.append(F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}")) * frac)
    return cum.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs).select(*keys, F.array(*qs).alias("q"))


def variation_and_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Coefficient of variation of x (sample deviation) and Pearson r; NULL where undefined."""
    cov = F.covar_pop(x, y)
    return df.groupBy(*keys).agg(
        F.try_divide(F.stddev_samp(x), F.avg(x)).alias("cv"),
        F.try_divide(cov, F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))).alias("pearson_r"))


def score_spread(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """A18"""
    return df.groupBy(*keys).agg(F.min(col).alias("min_score"), F.max(col).alias("max_score"),
                                 F.avg(col).alias("mean_score"), F.stddev_pop(col).alias("std_score"))


def class_weights(df: DataFrame, label: str, levels: Sequence[int], scheme: str) -> DataFrame:
    """None, balanced N/(K N_c), or its root; a class without rows weighs 1."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(int(v),) for v in levels], "label long")
    counts = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.filter(F.col(label).isin(list(levels))).agg(F.count(F.lit(1)).alias("total"))
    base = F.col("total") / (F.lit(float(len(levels))) * F.col("n"))
    weight = {"none": F.lit(1.0), "balanced": base, "sqrt": F.sqrt(base)}[scheme]
    return (dim.join(F.broadcast(counts), "label", "left").crossJoin(F.broadcast(total))
            .select("label", F.when(F.col("n").isNull(), 1.0).otherwise(weight).alias("weight")))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key; Spark keeps k per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def source_crosstab(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Items per category and source with their total."""
    d = df.groupBy("category").pivot("source", list(sources)).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(s) for s in sources[1:]), F.col(sources[0]))
    return d.withColumn("total_products", total)


def call_diagnostics(log: DataFrame) -> DataFrame:
    """Answers, failures, latency and token totals of a judgement log."""
    ok = F.col("status") == "OK"
    return log.agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(ok, 1).otherwise(0)).alias("ok"),
        F.sum(F.when(ok, 0).otherwise(1)).alias("failed"),
        F.min("elapsed_seconds").alias("min_latency"), F.max("elapsed_seconds").alias("max_latency"),
        F.avg("elapsed_seconds").alias("mean_latency"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def relabel(c: Column, mapping: Mapping) -> Column:
    """Look a value up in a fixed small mapping; NULL outside it."""
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.coalesce(F.when(c == k, F.lit(v)), out)
    return out
