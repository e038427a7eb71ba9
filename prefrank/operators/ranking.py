"""Rank-based columns, all on the skew-safe rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from prefrank.operators.conform import quantiles
from prefrank.operators.skew import average_rank, join_keys, rank_stats
from prefrank.session import cut_lineage


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_rank", "_ties", "_n")


def add_average_rank(df: DataFrame, keys: Sequence[str], col: str, out: str = "avg_rank") -> DataFrame:
    """W1"""
    return _clean(rank_stats(df, keys, col).withColumn(out, average_rank()))


def add_rank_pct(df: DataFrame, keys: Sequence[str], col: str, out: str = "rank_pct") -> DataFrame:
    """Average rank over the number of known values."""
    return _clean(rank_stats(df, keys, col).withColumn(out, average_rank() / F.col("_n")))


def add_min_rank_desc(df: DataFrame, keys: Sequence[str], col: str, out: str = "min_rank") -> DataFrame:
    """W3"""
    return _clean(rank_stats(df, keys, col, descending=True).withColumn(out, F.col("_rank")))


def add_rank_normalised(df: DataFrame, keys: Sequence[str], col: str, out: str = "rank_norm") -> DataFrame:
    """(values not above this one) / (n + 1)."""
    return _clean(rank_stats(df, keys, col).withColumn(
        out, (F.col("_rank") + F.col("_ties") - 1) / (F.col("_n") + 1)))


def add_minmax(df: DataFrame, keys: Sequence[str], col: str, out: str = "minmax") -> DataFrame:
    """To [0, 1] over the key; a constant column divides by one."""
    s = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    d = join_keys(df, s, keys) if keys else df.crossJoin(F.broadcast(s))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return d.withColumn(out, F.least(F.greatest((F.col(col) - F.col("_lo")) / span, F.lit(0.0)), F.lit(1.0))
                        ).drop("_lo", "_hi")


def best_position(df: DataFrame, keys: Sequence[str], truth: str = "true_score",
                  pred: str = "predicted_score") -> DataFrame:
    """Place of the truly best item in the predicted order (canonical best on ties)."""
    keys = list(keys)
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(truth).alias("t"), (-F.col(pred)).alias("p"))).alias("_b"))
    d = join_keys(df, best, keys)
    above = F.sum(F.when(F.col(pred) > -F.col("_b.p"), 1).otherwise(0))
    return d.groupBy(*keys).agg((above + 1).alias("best_position"))


def best_by(df: DataFrame, keys: Sequence[str], name: str, metric: str) -> DataFrame:
    """The name with the highest metric per key; the first name wins a tie."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(name).alias("n"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("_b.n").alias(name), (-F.col("_b.m")).alias(metric))


def add_quantile_bin(df: DataFrame, col: str, bins: int = 5, out: str = "bin") -> DataFrame:
    """Right-closed bins 1..bins at the exact quantile edges of the whole column."""
    df = cut_lineage(df)  # counted, cut and binned
    edges = quantiles(df.withColumn("_all", F.lit(1)), ["_all"], col, [i / bins for i in range(1, bins)]).select("q")
    d = df.crossJoin(F.broadcast(edges))
    return d.withColumn(out, (F.size(F.filter("q", lambda e: e < F.col(col))) + 1).cast("long")).drop("q")


def add_sequence(df: DataFrame, order: str, out: str) -> DataFrame:
    """0-based id over all rows in the order of a unique column, without a one-task sort."""
    from prefrank.operators.skew import row_index

    return row_index(df.withColumn("_all", F.lit(1)), ["_all"], order, out).drop("_all")
