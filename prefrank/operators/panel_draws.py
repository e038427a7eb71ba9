"""Group-size curves and split halves from one hashed order of raters per iteration.

An iteration puts a block's raters in one order; the panel of k raters is that order's first k, for every k,
and the halves are its first and second half. A block's ratings travel once for a batch of iterations, a row
for each rater, and the task takes prefix sums along the orders: a curve over 75 sizes costs as much as its largest.
Only the raters asked for are put in order. Blocks beyond a task (raters, or items whose pairs would be a large
square) take the same orders by windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefrank.functions.hashing import hash32
from prefrank.operators.conform import quantiles
from prefrank.operators.draws import CELLS, SQUARE, Names, in_batches
from prefrank.operators.metrics import pairwise_accuracy, ratio
from prefrank.operators.panel import BLOCK
from prefrank.operators.skew import broadcast_if_small, join_keys, rank_stats
from prefrank.session import cut_lineage, group_rows

TOLERANCE = 1e-10


def order_keys(heads: Sequence[str], raters: Names) -> np.ndarray:
    """Per head distinct keys in the order of hash32(head, respondent), ties by place (raters are given in rising order)."""
    return raters.hashes([h.encode() for h in heads]) << np.uint64(32) | np.arange(len(raters.names), dtype="u8")


def first_raters(heads: Sequence[str], raters: Names, top: int) -> np.ndarray:
    """Places of the first `top` raters in the order that belongs to each head."""
    keys = order_keys(heads, raters)
    some = np.partition(keys, top - 1)[:, :top] if top < keys.shape[1] else keys
    return (np.sort(some) & np.uint64(0xFFFFFFFF)).astype(int)


def credits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(correct, pairs) along the last axis; pairs with an unknown score on either side do not count."""
    shape = np.broadcast_shapes(x.shape, y.shape)
    correct, pairs = np.zeros(shape[:-1]), np.zeros(shape[:-1])
    for i in range(shape[-1] - 1):
        dx, dy = x[..., i + 1:] - x[..., i:i + 1], y[..., i + 1:] - y[..., i:i + 1]
        with np.errstate(invalid="ignore"):
            known = ~np.isnan(dx) & ~np.isnan(dy)
            tied = (np.abs(dx) < TOLERANCE) | (np.abs(dy) < TOLERANCE)
            correct += np.where(known, np.where(tied, 0.5, dx * dy > 0), 0.0).sum(-1)
            pairs += np.broadcast_to(known, dx.shape if dx.ndim >= dy.ndim else dy.shape).sum(-1)
    return correct, pairs


def _grid(pdf: pd.DataFrame) -> tuple[Names, np.ndarray, np.ndarray, np.ndarray]:
    """Raters in rising order, sums and counts of known ratings (raters x items), and each item's `true_score` if there is one."""
    rater, names = pd.factorize(pdf["respondent"], sort=True)
    rater = np.repeat(rater, pdf["item"].map(len))
    item, _ = pd.factorize(np.concatenate(pdf["item"].to_numpy()))
    value = np.concatenate(pdf["similarity"].to_numpy()).astype(float)
    known = ~np.isnan(value)
    sums, counts = np.zeros((len(names), item.max() + 1)), np.zeros((len(names), item.max() + 1))
    np.add.at(sums, (rater[known], item[known]), value[known])
    np.add.at(counts, (rater[known], item[known]), 1)
    first = np.unique(item, return_index=True)[1]
    truth = np.concatenate(pdf["true_score"].to_numpy()).astype(float)[first] if "true_score" in pdf else np.full(len(first), np.nan)
    return Names(names), sums, counts, truth


def _split(rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks that fit a task, a row for each rater with its items, the others with a row for each rating)."""
    known = rated.filter("respondent IS NOT NULL AND item IS NOT NULL")
    listed = [c for c in known.columns if c not in BLOCK and c != "respondent"]
    each = lambda c: F.col(c) if c == "item" else F.coalesce(F.col(c), F.lit(float("nan")))
    raters = cut_lineage(known.groupBy(*BLOCK, "respondent").agg(*[F.collect_list(each(c)).alias(c) for c in listed]))
    kinds = known.select(*BLOCK, "item").distinct().groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("items"))
    size = join_keys(raters.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("item")).alias("ratings")), kinds, BLOCK)
    limit = group_rows(rated.sparkSession)
    fits = (F.col("n") <= limit) & (F.col("ratings") <= 8 * limit) & (F.col("items") <= SQUARE)
    small = broadcast_if_small(cut_lineage(size.select(*BLOCK, fits.alias("_fits"))))
    return tuple(join_keys(d, small, BLOCK).filter(which).drop("_fits") for d, which in ((raters, "_fits"), (known, "NOT _fits")))


def _per_block(d: DataFrame, iterations: int, per_task: int, fields: str, make: Callable[[pd.DataFrame, range], Iterator[pd.DataFrame]]) -> DataFrame:
    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(make(pdf, range(int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])))))

    return in_batches(d, BLOCK, iterations, per_task).groupBy(*BLOCK, "_lo").applyInPandas(evaluate, fields)


def _ordered(big: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(iteration, block, respondent, _rank from 1, raters) by windows that no single task must hold."""
    raters = big.select(*BLOCK, "respondent").distinct()
    n = raters.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("raters"))
    d = join_keys(raters, broadcast_if_small(n), BLOCK).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    h = F.struct(hash32(seed, F.col("iteration"), F.col("respondent")).alias("h"), F.col("respondent").alias("r"))
    return rank_stats(d.withColumn("_h", h), ["iteration", *BLOCK], "_h").select("iteration", *BLOCK, "respondent", "_rank", "raters")


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = parts.groupBy(*keys).agg(F.sum("correct").alias("_c"), F.sum("pairs").alias("_p"))
    return s.filter("_p > 0").select(*keys, ratio(F.col("_c"), F.col("_p")).alias("pairwise_accuracy"))


def prefix_curve(ratings: DataFrame, rated: DataFrame, largest: int, iterations: int, seed: int, per_task: int = 100) -> DataFrame:
    """H4: (k, iteration, pairwise_accuracy) for every k up to `largest`: the mean of k raters of a block,
    drawn without replacement, against the full panel mean; blocks need more than k raters. Pairs are
    those within a block, pooled over blocks. Unknown ratings do not count, as do raters or items without name.
    """
    full = ratings.groupBy("category", "item").agg(F.avg("similarity").alias("true_score"))
    small, big = _split(join_keys(rated.select(*BLOCK, "respondent", "item", "similarity"), broadcast_if_small(full), ["category", "item"]))

    def curve(pdf: pd.DataFrame, span: range) -> Iterator[pd.DataFrame]:
        raters, sums, counts, truth = _grid(pdf)
        top = min(largest, len(sums) - 1)
        if top < 1:
            yield pd.DataFrame({"k": [], "iteration": [], "correct": [], "pairs": []}).astype({"k": "int32", "iteration": "int32"})
            return
        step = max(1, CELLS // max(top * sums.shape[1], len(sums)))
        for lo in range(span.start, span.stop, step):
            its = range(lo, min(span.stop, lo + step))
            chosen = first_raters([f"{seed}:{it}:" for it in its], raters, top)
            with np.errstate(invalid="ignore", divide="ignore"):
                means = np.cumsum(sums[chosen], 1) / np.cumsum(counts[chosen], 1)
            correct, pairs = credits(truth, means)
            yield pd.DataFrame({"k": np.tile(np.arange(1, top + 1, dtype="int32"), len(its)), "iteration": np.repeat(np.arange(its.start, its.stop, dtype="int32"), top),
                                "correct": correct.ravel(), "pairs": pairs.ravel()})

    parts = _per_block(small, iterations, per_task, "k int, iteration int, correct double, pairs double", curve)
    if not big.isEmpty():
        first = _ordered(big, iterations, seed).filter(F.col("_rank") <= largest)
        d = join_keys(big, first.drop("raters"), [*BLOCK, "respondent"]).groupBy("iteration", *BLOCK, "item", "_rank").agg(
            F.sum("similarity").alias("_s"), F.count("similarity").alias("_c"), F.first("true_score").alias("true_score"))
        # a panel of k holds all ranks up to k: at most `largest` rows of an item meet, in one ordered window
        w = W.partitionBy("iteration", *BLOCK, "item").orderBy("_rank")
        d = d.withColumn("_next", F.lead("_rank").over(w)).withColumn("_s", F.sum("_s").over(w)).withColumn("_c", F.sum("_c").over(w))
        n = big.groupBy(*BLOCK).agg((F.count_distinct("respondent") - 1).alias("_top"))
        d = join_keys(d, broadcast_if_small(n), BLOCK)
        last = F.least(F.coalesce(F.col("_next") - 1, F.lit(largest)), F.col("_top"))
        d = d.filter((F.col("_rank") <= last) & (F.col("_c") > 0) & F.col("true_score").isNotNull()).withColumn("k", F.explode(F.sequence(F.col("_rank").cast("int"), last.cast("int"))))
        keys = ["k", "iteration", *BLOCK]
        acc = pairwise_accuracy(d.select(*keys, "item", "true_score", (F.col("_s") / F.col("_c")).alias("predicted_score")), keys)
        parts = parts.unionByName(acc.select("k", "iteration", "correct", F.col("pairs").cast("double").alias("pairs")))
    return _summed(parts, ["k", "iteration"])


def sized_parts(full: DataFrame, rated: DataFrame, ks: Sequence[int], iterations: int, seed: int, per_task: int = 50) -> tuple[DataFrame, DataFrame]:
    """H4 with an order of its own for each size: (k, iteration, correct, pairs) of blocks that fit a task, and the ratings of the others."""
    small, big = _split(join_keys(rated.select(*BLOCK, "respondent", "item", "similarity"), broadcast_if_small(full), ["category", "item"]))

    def curve(pdf: pd.DataFrame, span: range) -> Iterator[pd.DataFrame]:
        raters, sums, counts, truth = _grid(pdf)
        yield pd.DataFrame({"k": [], "iteration": [], "correct": [], "pairs": []}).astype({"k": "int32", "iteration": "int32"})
        for k in ks:
            if len(sums) <= k:
                continue
            step = max(1, CELLS // len(sums))
            parts = [range(lo, min(span.stop, lo + step)) for lo in range(span.start, span.stop, step)]
            chosen = np.concatenate([first_raters([f"{seed}:{k}:{it}:" for it in its], raters, k) for its in parts])
            with np.errstate(invalid="ignore", divide="ignore"):
                means = np.stack([sums[c].sum(0) / counts[c].sum(0) for c in chosen])
            correct, pairs = credits(truth, means)
            some = (~np.isnan(means) & ~np.isnan(truth)).any(1)
            yield pd.DataFrame({"k": k, "iteration": np.arange(span.start, span.stop, dtype="int32"), "correct": correct, "pairs": pairs}).astype({"k": "int32"})[some]

    return _per_block(small, iterations, per_task, "k int, iteration int, correct double, pairs double", curve), big


def split_half_draws(rated: DataFrame, iterations: int, seed: int, per_task: int = 100) -> DataFrame:
    """H8: (iteration, pairwise_accuracy) between the means of two random halves of each block of four raters or more."""
    small, big = _split(rated.select(*BLOCK, "respondent", "item", "similarity"))

    def halves(pdf: pd.DataFrame, span: range) -> Iterator[pd.DataFrame]:
        raters, sums, counts, _ = _grid(pdf)
        cut = len(sums) // 2
        step = max(1, CELLS // len(sums))
        for lo in range(span.start, span.stop if len(sums) >= 4 else span.start, step):
            its = range(lo, min(span.stop, lo + step))
            keys = order_keys([f"{seed}:{it}:" for it in its], raters)
            early = (keys <= np.partition(keys, cut - 1)[:, cut - 1:cut]).astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                one, two = (side @ sums / (side @ counts) for side in (early, 1 - early))
            correct, pairs = credits(one, two)
            yield pd.DataFrame({"iteration": np.arange(its.start, its.stop, dtype="int32"), "correct": correct, "pairs": pairs})
        yield pd.DataFrame({"iteration": [], "correct": [], "pairs": []}).astype({"iteration": "int32"})

    parts = _per_block(small, iterations, per_task, "iteration int, correct double, pairs double", halves)
    if not big.isEmpty():
        side = _ordered(big, iterations, seed).filter("raters >= 4").select("iteration", *BLOCK, "respondent", (F.col("_rank") <= F.floor(F.col("raters") / 2)).alias("_first"))
        mean = lambda c: F.avg(F.when(c, F.col("similarity")))
        m = join_keys(big, side, [*BLOCK, "respondent"]).groupBy("iteration", *BLOCK, "item").agg(
            mean(F.col("_first")).alias("true_score"), mean(~F.col("_first")).alias("predicted_score"))
        acc = pairwise_accuracy(m.filter("true_score IS NOT NULL AND predicted_score IS NOT NULL"), ["iteration", *BLOCK])
        parts = parts.unionByName(acc.select("iteration", "correct", F.col("pairs").cast("double").alias("pairs")))
    return _summed(parts, ["iteration"])


def over_iterations(draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, accuracy, lo, hi, iterations): median and 2.5 % and 97.5 % points of the draws."""
    all_ = list(by) or ["_all"]
    draws = cut_lineage(draws)  # read by the quantiles and the count: the draws are made once
    d = draws if by else draws.withColumn("_all", F.lit(1))
    q: Column = F.col("q")
    n = d.groupBy(*all_).agg(F.count(F.lit(1)).alias("iterations"))
    out = quantiles(d, all_, "pairwise_accuracy", [0.5, 0.025, 0.975]).select(*all_, q[0].alias("accuracy"), q[1].alias("lo"), q[2].alias("hi"))
    return join_keys(out, n, all_).drop("_all")
