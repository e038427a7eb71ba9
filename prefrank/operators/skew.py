"""Sorted-order building blocks that never put a whole hot group into one task.

A window `PARTITION BY category ORDER BY x` sends each category to one task. That is the right
plan while every category is small, so `largest_group` measures it first. Once a category is too
large, its value range is cut at approximate quantiles into strips; windows then run per
(category, strip), and the strip totals, a small table, carry the sums across.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from prefrank.session import broadcast_bytes, broadcast_rows, cut_lineage, group_rows

MAX_CUTS = 4096


def is_small(df: DataFrame) -> bool:
    """Whether a table is counted to be under the session's bounds of rows and bytes for broadcasts."""
    bound = broadcast_rows(df.sparkSession)
    width = F.lit(8 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType):
            width = width + 8 * F.coalesce(F.size(F.flatten(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + 8 * F.coalesce(F.when(F.col(f"`{f.name}`").isNotNull(), F.size(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
    rows, size = df.limit(bound + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= bound and (size or 0) <= broadcast_bytes(df.sparkSession)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only for a table counted to be under the session's bounds of rows and bytes."""
    return F.broadcast(df) if is_small(df) else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on `keys` where null matches null; `left` names the keys of the result.

    Groups with a null key are groups like any other, so every way to compute a result joins like this.
    """
    keys = list(keys)
    if not keys:
        return left.join(right, how=how) if how == "left" else left.crossJoin(right)
    other = {k: f"_right_{i}" for i, k in enumerate(keys)}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    out = left.join(right.withColumnsRenamed(other), on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*other.values())


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows over all cores before each is multiplied: a small table may sit in one partition."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism), *cols)


def group_load(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group): one pre-aggregated pass."""
    row = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    )
    return int(row["total"] or 0), int(row["largest"] or 0)


def cut_points(df: DataFrame, keys: Sequence[str], col: str, largest: int) -> DataFrame | None:
    """Per hot group, sorted distinct quantile cuts of `col`; None while no group is hot.

    Written to the checkpoint folder: every later use must see the same cuts.
    """
    limit = group_rows(df.sparkSession)
    if largest <= limit:
        return None
    # Twice as many cuts as needed, but few enough that strip x strip cells stay well below the rows.
    k = max(2, min(MAX_CUTS, 2 * math.ceil(largest / limit), math.isqrt(largest) // 4))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    d = join_keys(df, broadcast_if_small(hot.select(*keys)), keys, "left_semi")
    if isinstance(df.schema[col].dataType, T.NumericType):
        probs = F.array(*[F.lit(i / k) for i in range(1, k)])
        found = F.percentile_approx(col, probs, max(10000, 10 * k))
    else:
        # Other orders are over unique values: a hashed sample of about 32 values per cut, thinned out.
        every = max(1, largest // (32 * k))
        d = d.filter(F.pmod(F.xxhash64(col), F.lit(every)) == 0)
        sample = F.array_sort(F.collect_list(col))
        found = F.filter(sample, lambda v, i: i % F.greatest(F.lit(1), F.floor(F.size(sample) / F.lit(k))) == 0)
    cuts = d.groupBy(*keys).agg(F.array_sort(F.array_distinct(found)).alias("_cuts"))
    return cut_lineage(cuts)


def add_strip(df: DataFrame, keys: Sequence[str], col: str, cuts: DataFrame | None, out: str) -> DataFrame:
    """Strip number of `col` in its group, rising with `col`; 0 for groups without cuts.

    A value equal to a cut gets an odd strip of its own, so a very frequent value never shares one.
    """
    if cuts is None:
        return df.withColumn(out, F.lit(0))
    v = F.col(col)
    below = F.size(F.filter("_cuts", lambda c: c < v))
    upto = F.size(F.filter("_cuts", lambda c: c <= v))
    return (
        join_keys(df, broadcast_if_small(cuts), keys, "left")
        .withColumn(out, F.coalesce(F.when(F.col("_cuts").isNotNull(), below + upto), F.lit(0)))
        .drop("_cuts")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], col: str, value: str, out: str, largest: int
) -> DataFrame:
    """Inclusive running sum of `value` by `col`; (keys, col) must be unique."""
    keys = list(keys)
    cuts = cut_points(df, keys, col, largest)
    if cuts is None:
        w = W.partitionBy(*keys).orderBy(col).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    d = add_strip(df, keys, col, cuts, "_strip")
    wk = W.partitionBy(*keys).orderBy("_strip").rowsBetween(W.unboundedPreceding, -1)
    base = (
        d.groupBy(*keys, "_strip").agg(F.sum(value).alias("_sum"))
        .select(*keys, "_strip", F.coalesce(F.sum("_sum").over(wk), F.lit(0)).alias("_base"))
    )
    ws = W.partitionBy(*keys, "_strip").orderBy(col).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_keys(d, base, [*keys, "_strip"])
        .withColumn(out, F.col("_base") + F.sum(value).over(ws))
        .drop("_base", "_strip")
    )


def rank_stats(
    df: DataFrame, keys: Sequence[str], col: str, prefix: str = "_", descending: bool = False,
    load: tuple[int, int] | None = None,
) -> DataFrame:
    """Add `<prefix>rank` (1 + values before), `<prefix>ties` (equal values) and `<prefix>n`
    (non-null values in the group), all BIGINT; NULL where `col` is NULL."""
    keys = list(keys)
    rank, ties, n = f"{prefix}rank", f"{prefix}ties", f"{prefix}n"
    _, largest = load or group_load(df, keys)
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()
    if largest <= group_rows(df.sparkSession):
        here = F.col(col).isNotNull()
        return (
            df.withColumn(rank, F.when(here, F.rank().over(W.partitionBy(*keys).orderBy(order)).cast("long")))
            .withColumn(ties, F.when(here, F.count(col).over(W.partitionBy(*keys, col))))
            .withColumn(n, F.when(here, F.count(col).over(W.partitionBy(*keys))))
        )
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias(ties))
    _, distinct = group_load(counts, keys)
    totals = counts.groupBy(*keys).agg(F.sum(ties).alias(n))
    cum = join_keys(running_total(counts, keys, col, ties, "_cum", distinct), totals, keys)
    before = F.col(n) - F.col("_cum") if descending else F.col("_cum") - F.col(ties)
    cum = cum.select(*keys, col, (before + 1).cast("long").alias(rank), ties, n)
    return join_keys(df, cum, [*keys, col], "left")


def average_rank(prefix: str = "_") -> Column:
    return F.col(f"{prefix}rank") + (F.col(f"{prefix}ties") - 1) / F.lit(2.0)


def row_index(df: DataFrame, keys: Sequence[str], order: str, out: str,
              load: tuple[int, int] | None = None) -> DataFrame:
    """0-based position of each row in its group by a unique column."""
    return rank_stats(df, keys, order, "_ix_", load=load).withColumn(
        out, F.col("_ix_rank") - 1).drop("_ix_rank", "_ix_ties", "_ix_n")
