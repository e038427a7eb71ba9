"""Pairs of items of one category, tournaments over them, and pair submissions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prefrank.functions.hashing import md5_is_even
from prefrank.functions.numeric import expit
from prefrank.functions.stats import t_two_sided
from prefrank.operators.concordance import pair_totals
from prefrank.operators.skew import broadcast_if_small, group_load, join_keys

TIE = 1e-10
TILE = 4096


def band_rows(largest: int, tile: int = TILE) -> int:
    """Rows of a chunk of a group of `largest` rows: at least `tile`, and growing with the root of the group.

    A row is sent once per chunk, so rows sent grow as the group's power 1.5. Tasks cut chunks into blocks again.
    """
    return max(tile, math.isqrt(largest * tile) // 4)


def _tiled(df: DataFrame, keys: Sequence[str], item: str, tile: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """Left and right copies of `df` keyed by (keys, _ca, _cb), so that every pair of chunks of a
    group meets in its own task; a group of at most `tile` rows stays in one piece."""
    keys = list(keys)
    if largest <= tile:
        one = df.withColumn("_ca", F.lit(0)).withColumn("_cb", F.lit(0))
        return one, one
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_chunks"))
    d = join_keys(df, broadcast_if_small(n), keys)
    own = F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    left = d.withColumn("_ca", own).withColumn("_cb", every).drop("_chunks")
    right = d.withColumn("_cb", own).withColumn("_ca", every).drop("_chunks")
    return left, right


def item_pairs(df: DataFrame, keys: Sequence[str], item: str, cols: Sequence[str], tile: int = TILE) -> DataFrame:
    """Each unordered pair of a group once (item_1 < item_2) with both sides' columns.

    The result has one row per pair by definition; metrics that only need counts over pairs use
    `concordance` instead.
    """
    keys = list(keys)
    d = df.select(*keys, item, *cols)
    _, largest = group_load(d, keys)
    left, right = _tiled(d, keys, item, tile, largest)
    on = [*keys, "_ca", "_cb"]
    a = left.withColumnsRenamed({c: f"{c}_1" for c in [item, *cols]})
    b = right.withColumnsRenamed({c: f"{c}_2" for c in [item, *cols]})
    return a.join(b, on).filter(F.col(f"{item}_1") < F.col(f"{item}_2")).drop("_ca", "_cb")


def labelled_pairs(items: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Pairs with their better item; ties are left out."""
    p = item_pairs(items, keys, "item", ["true_score"])
    d = F.col("true_score_1") - F.col("true_score_2")
    return p.filter(F.abs(d) >= TIE).select(
        *keys, "item_1", "item_2", F.when(d > 0, F.col("item_1")).otherwise(F.col("item_2")).alias("better"))


def pair_count(items: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Pairs per group, ties included, in closed form."""
    n = F.count(F.lit(1))
    return items.groupBy(*keys).agg((n * (n - 1) / 2).alias("pairs"))


def tie_count(items: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Pairs per group that `labelled_pairs` leaves out as ties, counted without listing them."""
    return pair_totals(items, keys, "true_score", "true_score", None, TIE).select(*keys, F.col("ties_x").cast("long").alias("ties"))


def difference_pairs(items: DataFrame, features: str, keys: Sequence[str] = ("category",), scheme: str = "none",
                     deviation: str = "std", count: str = "n") -> DataFrame:
    """(x_i - x_j, 1) and (x_j - x_i, 0) for every pair with y_i > y_j.

    With a weighting `scheme` (T4) each row has its pair's `weight`, from the items' `deviation` and `count`.
    """
    spread_cols = [deviation, count] if scheme in ("t_stat", "p_value") else []
    p = item_pairs(items, keys, "item", ["true_score", features, *spread_cols])
    p = p.filter(F.col("true_score_1") != F.col("true_score_2"))
    up = F.col("true_score_1") > F.col("true_score_2")
    hi = F.when(up, F.col(f"{features}_1")).otherwise(F.col(f"{features}_2"))
    lo = F.when(up, F.col(f"{features}_2")).otherwise(F.col(f"{features}_1"))
    both = F.array(
        F.struct(F.zip_with(hi, lo, lambda x, y: x - y).alias("diff"), F.lit(1.0).alias("label")),
        F.struct(F.zip_with(lo, hi, lambda x, y: x - y).alias("diff"), F.lit(0.0).alias("label")))
    weight = []
    if scheme != "none":
        sides = [F.col(f"{c}_{i}") for i in (1, 2) for c in spread_cols] or [F.lit(0.0)] * 4
        weight = [pair_weight(scheme, F.col("true_score_1") - F.col("true_score_2"), *sides).alias("weight")]
    return p.select(*keys, "item_1", "item_2", F.explode(both).alias("_e"), *weight).select(
        *keys, "item_1", "item_2", "_e.diff", "_e.label", *["weight"] * len(weight))


def pair_weight(scheme: str, d: Column, s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """T4: none, score_diff, t_stat (Welch, at most 5; 1 without spread) or p_value (1 - p)."""
    if scheme == "none":
        return F.lit(1.0)
    if scheme == "score_diff":
        return F.abs(d)
    one = F.lit(1)
    v1, v2 = s1 * s1 / F.greatest(n1, one), s2 * s2 / F.greatest(n2, one)
    se = F.sqrt(v1 + v2)
    t = F.abs(d) / F.nullif(se, F.lit(0.0))
    if scheme == "t_stat":
        return F.when(se > 0, F.least(t, F.lit(5.0))).otherwise(1.0)
    den = v1 * v1 / F.greatest(n1 - 1, one) + v2 * v2 / F.greatest(n2 - 1, one)
    df = F.coalesce((v1 + v2) * (v1 + v2) / F.nullif(den, F.lit(0.0)), F.lit(1.0))
    return F.when(se > 0, F.lit(1.0) - t_two_sided(t, df)).otherwise(1.0)


def tournament_scores(test: DataFrame, train: DataFrame, score: str, keys: Sequence[str] = ("category",),
                      tile: int = TILE) -> DataFrame:
    """T5: sum over same-group training items j of expit(s_i - s_j); 0 without any.

    Tiles of chunk x chunk are summed inside a task; pairs never become rows.
    """
    keys = list(keys)
    both = test.select(*keys, F.col("item"), F.col(score).cast("double").alias("_s"), F.lit(True).alias("_left")
                       ).unionByName(train.select(*keys, F.col("item"), F.col(score).cast("double").alias("_s"),
                                                  F.lit(False).alias("_left")))
    _, largest = group_load(both, keys)
    left, right = _tiled(both, keys, "item", band_rows(largest, tile), largest)
    on = [*keys, "_ca", "_cb"]

    def tile_sum(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*keys, "item", "part"]})
        s, ref = a["_s"].to_numpy(), b["_s"].to_numpy() if len(b) else np.zeros(0)
        part = np.concatenate([(1 / (1 + np.exp(-(c[:, None] - ref[None, :])))).sum(axis=1)
                               for c in np.array_split(s, len(s) * len(ref) // 4_000_000 + 1)])
        return a[keys + ["item"]].assign(part=part)

    schema = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in [*keys, "item"]) + ", part double"
    # New column names on both sides: cogroup refuses two frames that share columns.
    a, b = (d.toDF(*d.columns) for d in (left.filter("_left"), right.filter("NOT _left")))
    parts = (a.groupBy(*on).cogroup(b.groupBy(*on))
             .applyInPandas(tile_sum, schema))
    return parts.groupBy(*keys, "item").agg(F.sum("part").alias("tournament_score"))


def pair_probability(d: Column) -> Column:
    return expit(d)


def win_rates(log: DataFrame, items: DataFrame, code_map: DataFrame | None = None) -> DataFrame:
    """Wins / answered pairs of an item over OK judgements; 0.5 without any.

    With a code map (category, code, item) only the mapped side of a pair counts."""
    d = log.filter((F.col("status") == "OK") & F.col("prediction").isin("1", "2"))
    sides = F.array(
        F.struct(F.col("item_1").alias("code"), (F.col("prediction") == "1").alias("won")),
        F.struct(F.col("item_2").alias("code"), (F.col("prediction") == "2").alias("won")))
    d = d.select("category", F.explode(sides).alias("_s")).select("category", "_s.code", "_s.won")
    if code_map is not None:
        d = d.join(code_map, ["category", "code"])
    else:
        d = d.withColumnRenamed("code", "item")
    w = d.groupBy("category", "item").agg(F.sum(F.when(F.col("won"), 1).otherwise(0)).alias("wins"),
                                          F.count(F.lit(1)).alias("total"))
    return items.select("category", "item").join(w, ["category", "item"], "left").select(
        "category", "item", F.coalesce(F.col("wins") / F.col("total").cast("double"), F.lit(0.5)).alias("win_rate"))


def swapped_pairs(items: DataFrame, seed: int, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Pairs whose sides change places by a hashed coin."""
    p = item_pairs(items, keys, "item", [])
    coin = md5_is_even(*[F.col(k) for k in keys], F.col("item_1"), F.col("item_2"), seed)
    return p.select(*keys, F.when(coin, F.col("item_2")).otherwise(F.col("item_1")).alias("item_1"),
                    F.when(coin, F.col("item_1")).otherwise(F.col("item_2")).alias("item_2"))


def with_scores(pairs: DataFrame, scores: DataFrame, score: str, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Scores of both sides; NULL where an item has none."""
    keys = list(keys)
    for side in ("1", "2"):
        s = scores.select(*keys, F.col("item").alias(f"item_{side}"), F.col(score).alias(f"score_{side}"))
        pairs = pairs.join(s, [*keys, f"item_{side}"], "left")
    return pairs


def solution_label(s1: Column, s2: Column, i1: Column, i2: Column, eligible: Column) -> Column:
    """The better item; -1 for a tie, an unknown score or a pair outside the scored set."""
    known = s1.isNotNull() & s2.isNotNull() & eligible
    return F.when(known & (s1 > s2), i1).when(known & (s2 > s1), i2).otherwise(F.lit(-1))


def submission_choice(s1: Column, s2: Column, i1: Column, i2: Column) -> Column:
    """Ties and two unknowns pick the first; a known score beats an unknown one."""
    second = F.coalesce((s1.isNull() & s2.isNotNull()) | (s2 > s1), F.lit(False))
    return F.when(second, i2).otherwise(i1)


def hashed_submission(s1: Column, s2: Column, i1: Column, i2: Column, seed: int) -> Column:
    """The better item; a hashed coin for tied or unknown pairs."""
    coin = F.when(md5_is_even("fallback", i1, i2, seed), i2).otherwise(i1)
    return F.when(s1 > s2, i1).when(s2 > s1, i2).otherwise(coin)


def submission_score(answers: DataFrame, solution: DataFrame) -> DataFrame:
    """Share of matching answers per usage; -1 solutions do not count."""
    d = solution.filter(F.col("better") != -1).join(answers, ["test_id"], "left")
    return d.groupBy("usage").agg(
        F.avg(F.when(F.col("answer") == F.col("better"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def matched_submission(answers: DataFrame, solution: DataFrame, key: str) -> DataFrame:
    """Inner join that fails unless every solution row is answered exactly once."""
    n, distinct, hit = (
        solution.select(key).join(answers.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), [key], "left")
        .agg(F.count(F.lit(1)), F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)), F.sum(F.coalesce("_n", F.lit(0)))).first())
    if not (n == (distinct or 0) == (hit or 0)):
        raise ValueError(f"submission does not match the solution: {n} rows, {distinct} answered once")
    return solution.join(answers, [key])


def align_models(df: DataFrame, models: Sequence[str], keys: Sequence[str] = ("category", "item")) -> DataFrame:
    """One row per item with a column per model, items known to every model only."""
    d = df.filter(F.col("model").isin(list(models)) & F.col("predicted_score").isNotNull())
    cols = [F.max(F.when(F.col("model") == m, F.col("predicted_score"))).alias(m) for m in models]
    wide = d.groupBy(*keys).agg(F.max("true_score").alias("true_score"), *cols)
    return wide.dropna(subset=list(models))


def code_translated(df: DataFrame, code_map: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace code columns by their mapped codes."""
    m = broadcast_if_small(code_map)
    for c in cols:
        df = (df.join(m.select("category", F.col("code").alias(c), F.col("new_code").alias("_new")), ["category", c], "left")
              .withColumn(c, F.col("_new")).drop("_new"))
    return df


def rated_both(ratings: DataFrame, keys: Sequence[str] = ("category", "respondent")) -> DataFrame:
    """Per rater, the pairs of items with both ratings known."""
    return item_pairs(ratings.filter(F.col("similarity").isNotNull()), keys, "item", ["similarity"])
