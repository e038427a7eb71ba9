"""Rater panel analytics: blocks of raters who saw the same items, and their agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefrank.functions.hashing import hash32
from prefrank.operators.conform import leave_one_out_mean, quantiles
from prefrank.operators.metrics import pairwise_accuracy, ratio, recall_at, spearman
from prefrank.operators.pairs import item_pairs
from prefrank.operators.ranking import add_quantile_bin
from prefrank.operators.skew import average_rank, broadcast_if_small, group_load, join_keys, rank_stats, row_index, running_total, spread
from prefrank.session import cut_lineage

BLOCK = ["category", "block_id"]


def rater_sets(ratings: DataFrame) -> DataFrame:
    """(category, respondent, set_key): equal keys mean equal item sets, repeats included.

    The key is the item count with three independent 64-bit sums and xors of item hashes, so a rater
    with very many ratings is aggregated map-side like any other."""
    h = F.xxhash64("item")
    key = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64("item", F.lit("second"))),
                      F.sum(h.cast("decimal(38,0)")))
    return ratings.groupBy("category", "respondent").agg(key.alias("set_key"))


def blocks(ratings: DataFrame, analogs: DataFrame, min_raters: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H1: raters of a category who rated exactly the same items, at least `min_raters` of them and
    at least two analogs; block ids count from 0 by falling size, then by lowest rater.

    Returns blocks (category, block_id, n_respondents, n_items), the analogs of each block
    (category, block_id, item), and its raters (category, block_id, respondent).
    """
    who = rater_sets(ratings)
    sets = who.groupBy("category", "set_key").agg(F.count(F.lit(1)).alias("n_respondents"), F.min("respondent").alias("_first"))
    sets = sets.filter(F.col("n_respondents") >= min_raters)
    # The items of a block are those of its lowest rater.
    items = ratings.join(sets.select("category", "set_key", F.col("_first").alias("respondent")), ["category", "respondent"])
    items = items.select("category", "set_key", "item")
    pool = analogs.select("category", "item").distinct().withColumn("_analog", F.lit(1))
    sizes = items.join(pool, ["category", "item"], "left").groupBy("category", "set_key").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("_analog").alias("_n"))
    kept = sets.join(sizes.filter("_n >= 2").drop("_n"), ["category", "set_key"])
    kept = kept.withColumn("_order", F.struct((-F.col("n_respondents")).alias("n"), F.col("_first").alias("r")))
    kept = cut_lineage(row_index(kept, ["category"], "_order", "block_id").drop("_order", "_first"))
    small = broadcast_if_small(kept.select("category", "set_key", "block_id"))
    block_items = items.join(small, ["category", "set_key"]).join(pool, ["category", "item"], "left_semi")
    return (kept.select("category", "block_id", "n_respondents", "n_items"),
            block_items.select("category", "block_id", "item"),
            who.join(small, ["category", "set_key"]).select("category", "block_id", "respondent"))


def block_ratings(ratings: DataFrame, block_items: DataFrame, raters: DataFrame) -> DataFrame:
    """Ratings of analogs by the raters of a block: (category, block_id, respondent, item, similarity)."""
    d = ratings.join(raters, ["category", "respondent"])
    d = d.join(broadcast_if_small(block_items), ["category", "block_id", "item"], "left_semi")
    return cut_lineage(d.select(*BLOCK, "respondent", "item", "similarity"))  # every panel analysis starts here


def individual_accuracy(ratings: DataFrame, rated: DataFrame) -> DataFrame:
    """H3: each rater against the mean of the others: accuracy, Spearman, recall@1 and @3."""
    keys = [*BLOCK, "respondent"]
    loo = leave_one_out_mean(ratings).select("category", "respondent", "item", F.col("loo_mean").alias("true_score"))
    d = rated.join(loo, ["category", "respondent", "item"]).withColumn("predicted_score", F.col("similarity"))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_analogs")).filter("n_analogs >= 2")
    d = cut_lineage(d.join(n.select(*keys), keys, "left_semi"))  # read by every metric below
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_analogs"))
    return (n.join(pairwise_accuracy(d, keys), keys).join(spearman(d, keys), keys).join(recall_at(d, keys, (1, 3)), keys)
            .drop("correct").withColumnRenamed("pairs", "n_pairs"))


def _panel_credit(means: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    acc = pairwise_accuracy(means.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()), [*keys, *BLOCK], truth, pred)
    return acc.groupBy(*keys).agg(ratio(F.sum("correct"), F.sum("pairs")).alias("pairwise_accuracy"))


def group_size_curve(ratings: DataFrame, rated: DataFrame, ks: Sequence[int], iterations: int, seed: int) -> DataFrame:
    """H4: accuracy of the mean of k raters per block, drawn without replacement, against the full
    panel mean; blocks need more than k raters. Pooled over blocks per (k, iteration). Raters and items without
    name do not count. Blocks that fit a task get their draws there, the others by windows."""
    from prefrank.operators.panel_draws import sized_parts  # it builds on this module's blocks

    full = cut_lineage(ratings.groupBy("category", "item").agg(F.avg("similarity").alias("true_score")))
    parts, rated = sized_parts(full, rated, ks, iterations, seed)
    if not rated.isEmpty():
        parts = parts.unionByName(_window_parts(rated, ks, iterations, seed))
    return parts.groupBy("k", "iteration").agg(ratio(F.sum("correct"), F.sum("pairs")).alias("pairwise_accuracy"))


def _window_parts(rated: DataFrame, ks: Sequence[int], iterations: int, seed: int) -> DataFrame:
    """(k, iteration, correct, pairs) per block by windows; `rated` has the items' true_score."""
    raters = rated.select(*BLOCK, "respondent").distinct()
    size = raters.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    d = spread(join_keys(raters, broadcast_if_small(size), BLOCK), *BLOCK, "respondent").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    d = d.filter(F.col("_n") >= F.col("k") + 1).withColumn(
        "iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    # Spark keeps k rows per task before the shuffle; a block's draw order is its hash order.
    w = W.partitionBy("k", "iteration", *BLOCK).orderBy(
        hash32(seed, F.col("k"), F.col("iteration"), F.col("respondent")), "respondent")
    top = max(ks)
    d = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).filter(F.col("_r") <= F.col("k"))
    m = join_keys(rated, d.select("k", "iteration", *BLOCK, "respondent"), [*BLOCK, "respondent"]).groupBy("k", "iteration", *BLOCK, "item").agg(
        F.avg("similarity").alias("predicted_score"), F.first("true_score").alias("true_score"))
    acc = pairwise_accuracy(m.filter("true_score IS NOT NULL AND predicted_score IS NOT NULL"), ["k", "iteration", *BLOCK])
    return acc.select("k", "iteration", "correct", F.col("pairs").cast("double").alias("pairs"))


def interpolated_k(curve: DataFrame, target: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """H5: first k whose accuracy reaches the target, interpolated from the k before; one row per k."""
    w = W.partitionBy(*by).orderBy("k") if by else W.partitionBy(F.lit(0)).orderBy("k")
    t = F.lit(target) if isinstance(target, float) else target
    d = curve.withColumn("_pk", F.lag("k").over(w)).withColumn("_pa", F.lag("accuracy").over(w))
    step = (t - F.col("_pa")) / (F.col("accuracy") - F.col("_pa"))
    at = F.when(F.col("_pk").isNull() | (F.col("accuracy") <= F.col("_pa")), F.col("k").cast("double")).otherwise(
        F.col("_pk") + step * (F.col("k") - F.col("_pk")))
    return d.filter(F.col("accuracy") >= t).groupBy(*by).agg(F.min_by(at, F.col("k")).alias("k_star"))


def krippendorff_alpha(rated: DataFrame, keys: Sequence[str] = BLOCK, unit: str = "item", value: str = "similarity") -> DataFrame:
    """H6: ordinal alpha from value counts per unit.

    The pairs of values within a unit enter through counts per distinct value, so the work grows
    with the distinct ratings of the scale, not with rater pairs.
    """
    keys = list(keys)
    d = rated.filter(F.col(value).isNotNull())
    c = d.groupBy(*keys, unit, F.col(value).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    m = c.groupBy(*keys, unit).agg(F.sum("c").alias("m")).filter("m >= 2")
    c = c.join(m, [*keys, unit])
    marg = c.groupBy(*keys, "v").agg(F.sum("c").alias("nv"))
    # Distance of two ordinal values: marginal mass between them, half of each end. With g(v) the
    # mass below v plus half of n_v, delta(c, k) = g(k) - g(c), so squared sums need no value pairs.
    marg = running_total(marg, keys, "v", "nv", "_cum", group_load(marg, keys)[1])
    marg = marg.withColumn("g", F.col("_cum") - F.col("nv") / 2)
    c = c.join(marg.select(*keys, "v", "g"), [*keys, "v"])
    per = c.groupBy(*keys, unit).agg(F.max("m").alias("m"), F.sum(F.col("c") * F.col("g")).alias("s1"),
                                     F.sum(F.col("c") * F.col("g") * F.col("g")).alias("s2"))
    observed = per.groupBy(*keys).agg(F.sum(2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1)).alias("_o"))
    tot = marg.groupBy(*keys).agg(F.sum("nv").alias("n"), F.sum(F.col("nv") * F.col("g")).alias("s1"),
                                  F.sum(F.col("nv") * F.col("g") * F.col("g")).alias("s2"))
    d_o = F.col("_o") / F.col("n")
    d_e = 2 * (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("n") * (F.col("n") - 1))
    return tot.join(observed, keys).select(*keys, (F.lit(1.0) - ratio(d_o, d_e)).alias("krippendorff_alpha"))


def kendall_w(rated: DataFrame, keys: Sequence[str] = BLOCK) -> DataFrame:
    """H7: concordance of raters without tie correction; a missing rating is the rater's mean."""
    keys = list(keys)
    items = rated.select(*keys, "item").distinct()
    raters = rated.groupBy(*keys, "respondent").agg(F.avg("similarity").alias("_mean"))
    grid = raters.join(items, keys).join(rated.select(*keys, "respondent", "item", "similarity"), [*keys, "respondent", "item"], "left")
    grid = grid.withColumn("_v", F.coalesce("similarity", "_mean"))
    r = rank_stats(grid, [*keys, "respondent"], "_v").select(*keys, "item", average_rank().alias("_r"))
    sums = r.groupBy(*keys, "item").agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("m"))
    d = sums.groupBy(*keys).agg((F.var_pop("_s") * F.count(F.lit(1))).alias("_ss"), F.max("m").cast("double").alias("m"),
                                F.count(F.lit(1)).cast("double").alias("n"))
    w = ratio(12 * F.col("_ss"), F.col("m") * F.col("m") * (F.pow("n", F.lit(3.0)) - F.col("n")))
    return d.select(*keys, F.when((F.col("m") >= 2) & (F.col("n") >= 2), w).alias("kendall_w"))


def split_half(rated: DataFrame, iterations: int, seed: int) -> DataFrame:
    """H8: accuracy between the means of two random halves of a block, pooled per iteration."""
    raters = rated.select(*BLOCK, "respondent").distinct()
    n = raters.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 4")
    d = spread(raters.join(broadcast_if_small(n), BLOCK), *BLOCK, "respondent").withColumn(
        "iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    h = hash32(seed, F.col("iteration"), F.col("respondent"))
    # The hash alone may tie; the respondent makes the order total.
    d = rank_stats(d.withColumn("_h", F.struct(h.alias("h"), F.col("respondent").alias("r"))), ["iteration", *BLOCK], "_h")
    d = d.select("iteration", *BLOCK, "respondent", (F.col("_rank") <= F.floor(F.col("_n") / 2)).alias("_first"))
    m = (d.join(rated, [*BLOCK, "respondent"]).groupBy("iteration", *BLOCK, "item")
         .agg(F.avg(F.when(F.col("_first"), F.col("similarity"))).alias("half1"),
              F.avg(F.when(~F.col("_first"), F.col("similarity"))).alias("half2")))
    return _panel_credit(m, ["iteration"], "half1", "half2")


def rater_pair_agreement(signs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """H9: agreement of two raters on an item pair from (n_pos, n_neg, n_tie) counts."""
    p, q, n = (F.col(c).cast("double") for c in ("n_pos", "n_neg", "n_tie"))
    all_ = p + q + n
    total = all_ * (all_ - 1) / 2
    same = p * (p - 1) / 2 + q * (q - 1) / 2
    tie = total - same - p * q
    return signs.groupBy(*by).agg(ratio(F.sum(same + tie / 2), F.sum(total)).alias("agreement"))


def pair_signs(rated: DataFrame, keys: Sequence[str] = BLOCK) -> DataFrame:
    """H9 input: per item pair, the raters who prefer the first, the second, or neither."""
    p = item_pairs(rated.filter(F.col("similarity").isNotNull()), [*keys, "respondent"], "item", ["similarity"])
    d = F.col("similarity_1") - F.col("similarity_2")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return p.groupBy(*keys, "item_1", "item_2").agg(n(d > 0).alias("n_pos"), n(d < 0).alias("n_neg"), n(d == 0).alias("n_tie"))


def pair_difficulty(ratings: DataFrame, rated: DataFrame, model: DataFrame, bins: int = 5) -> DataFrame:
    """Human and model accuracy by quantile bins of the gap between panel means."""
    tie = 1e-10
    mean = ratings.groupBy("category", "item").agg(F.avg("similarity").alias("truth"))
    items = rated.select("category", "item").distinct().join(mean, ["category", "item"]).join(
        model.select("category", "item", "predicted_score"), ["category", "item"], "left")
    p = item_pairs(items, ["category"], "item", ["truth", "predicted_score"])
    gap = F.col("truth_1") - F.col("truth_2")
    pred = F.col("predicted_score_1") - F.col("predicted_score_2")

    def credit(d: Column) -> Column:
        return (F.when(d.isNull(), None).when(F.abs(gap) < tie, 0.5).when(F.abs(d) < tie, 0.5)
                .when(gap * d > 0, 1.0).otherwise(0.0))

    p = p.withColumn("difficulty", F.abs(gap)).withColumn("model_credit", credit(pred))
    # Raters enter as sign counts per pair: ahead, behind, tied.
    s = pair_signs(rated).groupBy("category", "item_1", "item_2").agg(*[F.sum(c).alias(c) for c in ("n_pos", "n_neg", "n_tie")])
    p = p.join(s, ["category", "item_1", "item_2"], "left")
    n = F.col("n_pos") + F.col("n_neg") + F.col("n_tie")
    hit = F.when(gap > 0, F.col("n_pos")).otherwise(F.col("n_neg")) + F.col("n_tie") * F.lit(0.5)
    p = p.withColumn("human_credit", F.when(F.abs(gap) < tie, F.when(n > 0, 0.5)).otherwise(ratio(hit, n)))
    d = add_quantile_bin(p, "difficulty", bins, "difficulty_bin")
    return d.groupBy("difficulty_bin").agg(
        F.avg("human_credit").alias("human_accuracy"), F.avg("model_credit").alias("model_accuracy"),
        F.count("difficulty").alias("n_pairs"), F.avg("difficulty").alias("mean_difficulty"))


def meta_rollup(individual: DataFrame, alpha: DataFrame, model_acc: DataFrame, groups: Mapping[str, Sequence]) -> DataFrame:
    """Median rater accuracy, model accuracy, mean alpha and categories per meta-group."""
    dim = individual.sparkSession.createDataFrame([(c, g) for g, cs in groups.items() for c in cs], "category string, meta string")
    tag = lambda d: d.join(F.broadcast(dim), "category")
    human = quantiles(tag(individual), ["meta"], "pairwise_accuracy", [0.5]).select("meta", F.col("q")[0].alias("human_median_accuracy"))
    n = tag(individual).groupBy("meta").agg(F.countDistinct("category").alias("n_categories"))
    model = tag(model_acc).groupBy("meta").agg(ratio(F.sum("correct"), F.sum("pairs")).alias("model_accuracy"))
    rel = tag(alpha).groupBy("meta").agg(F.avg("krippendorff_alpha").alias("mean_alpha"))
    return human.join(n, "meta").join(model, "meta", "left").join(rel, "meta", "left")


def model_within_blocks(block_items: DataFrame, oof: DataFrame) -> DataFrame:
    """Model accuracy on the pairs a block's raters saw, pooled over blocks."""
    d = block_items.join(oof, ["category", "item"])
    acc = pairwise_accuracy(d, BLOCK)
    rho = spearman(d, BLOCK).join(d.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n")), BLOCK)
    known = F.when(F.col("spearman").isNotNull(), F.col("n"))
    return acc.agg(ratio(F.sum("correct"), F.sum("pairs")).alias("pairwise_accuracy")).crossJoin(
        rho.agg(ratio(F.sum(F.col("spearman") * F.col("n")), F.sum(known)).alias("spearman")))


def share_exceeded(individual: DataFrame, target: float | Column) -> DataFrame:
    """Percent of raters below the model."""
    return individual.agg((F.avg(F.when(F.col("pairwise_accuracy") < target, 1.0).otherwise(0.0)) * 100).alias("percent_exceeded"))


def comparison_table(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One labelled row per source of accuracy; every part has a single `accuracy` row."""
    out = None
    for name, d in parts.items():
        row = d.select(F.lit(name).alias("source"), F.col("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def release_table(rated: DataFrame, columns: Sequence[str], person: str = "respondent") -> DataFrame:
    """Ratings without the person key, sorted by every released column."""
    if person in columns:
        raise ValueError(f"{person} must not be released")
    return rated.select(*columns).orderBy(*columns)
