"""Scores from the distance of an item to the reference items of its category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from prefrank.functions.vectors import cosine_distance, euclidean
from prefrank.operators.features import impute_column_means, pooled, scaled
from prefrank.operators.ranking import add_minmax, add_rank_normalised
from prefrank.operators.skew import broadcast_if_small


def centroid_distances(blocks: DataFrame, metric: str = "cosine", scaler: str = "standard") -> DataFrame:
    """(category, item, block, distance). `blocks` has category, item, is_reference, block, vec.

    Each block is imputed and scaled on its own; a sub-block for a set of categories is just
    another block name (D2)."""
    d = scaled(impute_column_means(blocks, ["block"], "vec"), ["block"], "vec", scaler)
    c = pooled(d.filter("is_reference"), ["block", "category"], "vec", out="_c")
    d = d.join(broadcast_if_small(c), ["block", "category"], "left")
    dist = cosine_distance if metric == "cosine" else euclidean
    return d.select("category", "item", "block", dist(F.col("vec"), F.col("_c")).alias("distance"))


def normalised(dist: DataFrame, how: str = "rank") -> DataFrame:
    """W4 or W5 per block; `none` keeps the distance."""
    if how == "rank":
        return add_rank_normalised(dist, ["block", "category"], "distance", "norm")
    if how == "minmax":
        return add_minmax(dist, ["block"], "distance", "norm")
    return dist.withColumn("norm", F.col("distance"))


def combined(norm: DataFrame, items: DataFrame, weights: Mapping[str, float], missing: str = "skip") -> DataFrame:
    """Minus the weighted mean of an item's normalised distances.

    A missing distance is skipped, counted as zero, or makes the score unknown (`nan`)."""
    table = norm.sparkSession.createDataFrame([(b, float(w)) for b, w in weights.items()], "block string, weight double")
    want = items.select("category", "item").crossJoin(F.broadcast(table)).join(
        norm.select("category", "item", "block", "norm"), ["category", "item", "block"], "left")
    w = F.col("weight")
    if missing == "zero":
        want = want.withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    known = F.when(F.col("norm").isNotNull(), w)
    score = -F.try_divide(F.sum(F.col("norm") * w), F.sum(known))
    if missing == "nan":
        score = F.when(F.count("norm") == F.count(F.lit(1)), score)
    return want.groupBy("category", "item").agg(score.alias("score"))


def subset_names(blocks: Sequence[str]) -> list[list[str]]:
    """Every non-empty subset, small ones first."""
    return [list(c) for n in range(1, len(blocks) + 1) for c in combinations(blocks, n)]


def subset_sweep(norm: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """D3: scores of every block subset from distances computed once."""
    sets = [("".join(s), b) for s in subset_names(blocks) for b in s]
    table = F.broadcast(norm.sparkSession.createDataFrame(sets, "subset string, block string"))
    d = norm.join(table, "block")
    return d.groupBy("subset", "category", "item").agg((-F.avg("norm")).alias("score"))
