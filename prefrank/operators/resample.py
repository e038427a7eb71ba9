"""Bootstrap, jackknife and interval operators.

A resample is a table of multiplicities: every row of a stratum acts as one draw slot and hashes
(seed, pair of replicates, stratum, slot) to the positions it draws in the two. Draws therefore do not depend on row
order or partitioning, and a lost task recomputes the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from prefrank.functions.hashing import replicate_index
from prefrank.functions.stats import chi2_one_upper, f_upper, normal_cdf, normal_quantile
from prefrank.operators import draws
from prefrank.operators.classify import class_scores, confusion, one_vs_rest_auc
from prefrank.operators.concordance import item_credit
from prefrank.operators.conform import quantiles
from prefrank.operators.metrics import pairwise_accuracy, ratio
from prefrank.operators.skew import broadcast_if_small, group_load, join_keys, rank_stats, row_index, spread
from prefrank.session import cut_lineage, group_rows

#: Deviations of a resample's median that are coded at first.
REACH = 6.0


def bootstrap_weights(df: DataFrame, strata: Sequence[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """B1: (rep, strata, unit, w): how often each unit is drawn; units that are never drawn are absent.

    `unit` is unique within its stratum; each stratum keeps its size in every replicate. Strata that fit a task
    get their draws there, a batch of replicates at a time; with a larger one each slot is drawn as a row."""
    strata = list(strata)
    plain = not isinstance(df.schema[unit].dataType, (T.StructType, T.ArrayType, T.MapType))
    if plain and "rep" not in strata:
        df = cut_lineage(df.select(*strata, unit))  # counted and drawn from
        largest = group_load(df, strata)[1] if strata else df.count()
        if largest <= group_rows(df.sparkSession):
            return draws.listed_draws(df, strata, unit, largest, replicates, seed)
    base = df.select(*strata, unit) if strata else df.select(unit).withColumn("_all", F.lit(0))
    base = cut_lineage(base)  # counted, numbered and drawn from
    keys = strata or ["_all"]
    ix = row_index(base, keys, unit, "_pos")
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = spread(join_keys(ix, broadcast_if_small(n), keys), *keys, "_pos").withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pos = replicate_index(F.col("_n"), seed, F.col("rep"), *[F.col(k) for k in strata], F.col("_pos"))
    drawn = slots.select("rep", *keys, pos.alias("_pos")).groupBy("rep", *keys, "_pos").agg(F.count(F.lit(1)).alias("w"))
    return join_keys(drawn, ix, [*keys, "_pos"]).select("rep", *strata, unit, "w")


def bootstrap_accuracy(oof: DataFrame, replicates: int, seed: int, by: Sequence[str] = ("model",),
                       stratum: str = "category", per_stratum: bool = False) -> DataFrame:
    """Pairwise accuracy of every replicate; copies of one item tie with each other (one half).

    Strata that fit a task get their draws there, a batch of replicates at a time; larger ones are drawn row by row."""
    by = list(by)
    oof = cut_lineage(oof.select(*by, stratum, "item", "true_score", "predicted_score"))
    total, largest = group_load(oof, [stratum])
    if largest <= group_rows(oof.sparkSession):
        acc = draws.accuracy_draws(oof, replicates, seed, by, stratum, total=total)
        if per_stratum:
            return acc.select(*by, stratum, "rep", ratio("correct", "pairs").alias("value"))
        return acc.groupBy(*by, "rep").agg(ratio(F.sum("correct"), F.sum("pairs")).alias("value"))
    w = bootstrap_weights(oof.select(stratum, "item").distinct(), [stratum], "item", replicates, seed)
    total, largest = group_load(oof, [*by, stratum])  # a replicate never has more distinct rows
    acc = pairwise_accuracy(join_keys(oof, w, [stratum, "item"]), [*by, "rep", stratum], weight="w",
                            load=(total * replicates, largest))
    if per_stratum:
        return acc.select(*by, stratum, "rep", F.col("pairwise_accuracy").alias("value"))
    return acc.groupBy(*by, "rep").agg(ratio(F.sum("correct"), F.sum("pairs")).alias("value"))


def jackknife_accuracy(oof: DataFrame, by: Sequence[str] = ("model",), stratum: str = "category") -> DataFrame:
    """Pairwise accuracy without each item, in closed form from the item's own credit."""
    by = list(by)
    d = cut_lineage(item_credit(cut_lineage(oof.select(*by, stratum, "item", "true_score", "predicted_score")), [*by, stratum], "true_score", "predicted_score"))
    cat = d.groupBy(*by, stratum).agg(F.sum("credit").alias("_c"), F.count(F.lit(1)).alias("_n"))
    n = F.col("_n").cast("double")
    tot = cat.groupBy(*by).agg((F.sum("_c") / 2).alias("_C"), F.sum(n * (n - 1) / 2).alias("_P"))
    d = join_keys(d, broadcast_if_small(cat.select(*by, stratum, "_n")), [*by, stratum])
    d = join_keys(d, broadcast_if_small(tot), by) if by else d.crossJoin(F.broadcast(tot))
    value = ratio(F.col("_C") - F.col("credit"), F.col("_P") - (F.col("_n") - 1))
    return d.select(*by, stratum, "item", value.alias("value"))


def percentile_interval(boot: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """B7"""
    q = quantiles(boot, keys, "value", [alpha / 2, 1 - alpha / 2])
    return q.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def bca_interval(observed: DataFrame, boot: DataFrame, jack: DataFrame, keys: Sequence[str],
                 variant: str = "strict", alpha: float = 0.05) -> DataFrame:
    """Bias-corrected accelerated intervals, all models and metrics at once.

    strict: share of draws below the estimate, kept off 0 and 1 by 1e-10; level one half if the
    denominator vanishes. midp: half of the equal draws count as below, no clipping. filtered:
    unknown draws are dropped, at least ten must remain, clip 1e-6, denominator at least 1e-9.
    """
    keys = list(keys)
    b = cut_lineage(boot.filter(F.col("value").isNotNull()))  # read three times below
    o = observed.select(*keys, F.col("value").alias("point"))
    j = cut_lineage(jack.filter(F.col("value").isNotNull()))
    mean = j.groupBy(*keys).agg(F.avg("value").alias("_m"))
    dev = F.col("_m") - F.col("value")
    acc = (join_keys(j, broadcast_if_small(mean), keys).groupBy(*keys)
           .agg(F.sum(dev * dev * dev).alias("_s3"), F.sum(dev * dev).alias("_s2"), F.count(F.lit(1)).alias("_nj"))
           .select(*keys, F.coalesce(F.col("_s3") / F.nullif(6 * F.pow("_s2", F.lit(1.5)), F.lit(0.0)), F.lit(0.0)).alias("_a"), "_nj"))
    below = F.when(F.col("value") < F.col("point"), 1.0).otherwise(0.0)
    if variant == "midp":
        below = below + F.when(F.col("value") == F.col("point"), 0.5).otherwise(0.0)
    share = join_keys(b, broadcast_if_small(o), keys).groupBy(*keys).agg(F.avg(below).alias("_p"), F.count(F.lit(1)).alias("_nb"))
    clip = {"strict": 1e-10, "midp": 0.0, "filtered": 1e-6}[variant]
    d = join_keys(join_keys(o, share, keys, "left"), acc, keys, "left")
    d = d.withColumn("_z0", normal_quantile(F.least(F.greatest("_p", F.lit(clip)), F.lit(1.0 - clip))))
    if variant == "filtered":
        d = d.withColumn("_a", F.when(F.col("_nj") >= 2, F.col("_a")).otherwise(0.0))
    levels = []
    for name, level in (("lo", alpha / 2), ("hi", 1 - alpha / 2)):
        z = F.col("_z0") + normal_quantile(F.lit(level))
        den = F.lit(1.0) - F.col("_a") * z
        if variant == "filtered":
            q = normal_cdf(F.col("_z0") + z / F.greatest(den, F.lit(1e-9)))
        else:
            q = F.when(F.abs(den) < 1e-10, 0.5).otherwise(
                normal_cdf(F.col("_z0") + z / F.when(F.abs(den) < 1e-10, 1.0).otherwise(den)))
        levels.append(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)).alias(f"_q{name}"))
    d = d.select(*keys, "point", "_nb", *levels)
    # One key holds as many draws as replicates, a fixed small number.
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("value")) - 1
    ranked = join_keys(b.select(*keys, "value", pos.alias("_i")), broadcast_if_small(d), keys)
    picks = []
    for name in ("lo", "hi"):
        h = F.col(f"_q{name}") * (F.col("_nb") - 1)
        frac = h - F.floor(h)
        low = F.max(F.when(F.col("_i") == F.floor(h), F.col("value")))
        high = F.max(F.when(F.col("_i") == F.ceil(h), F.col("value")))
        picks.append((low + (high - low) * F.max(frac)).alias(name))
    out = ranked.groupBy(*keys).agg(*picks)
    out = join_keys(d.select(*keys, "point", "_nb"), out, keys, "left")
    if variant == "filtered":
        out = out.select(*keys, "point", *[F.when(F.col("_nb") >= 10, F.col(c)).alias(c) for c in ("lo", "hi")])
    return out.select(*keys, "point", "lo", "hi")


def cluster_bootstrap(blocks: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """Sum of correct over sum of pairs for every resample of whole blocks."""
    if draws.one_task(blocks):
        d = draws.weighted_sums(blocks, unit, {"correct": F.col("correct"), "pairs": F.col("pairs")}, replicates, seed)
        return d.select("rep", ratio("correct", "pairs").alias("value"))
    w = bootstrap_weights(blocks, [], unit, replicates, seed)
    d = blocks.join(w, [unit])
    return d.groupBy("rep").agg(ratio(F.sum(F.col("correct") * F.col("w")), F.sum(F.col("pairs") * F.col("w"))).alias("value"))


def cluster_jackknife(blocks: DataFrame, unit: str) -> DataFrame:
    """The same ratio without each block."""
    tot = blocks.agg(F.sum("correct").alias("_c"), F.sum("pairs").alias("_p"))
    return blocks.crossJoin(F.broadcast(tot)).select(
        unit, ratio(F.col("_c") - F.col("correct"), F.col("_p") - F.col("pairs")).alias("value"))


def bootstrap_classifier(probs: DataFrame, row: str, levels: Sequence[int], cols: Sequence[str],
                         replicates: int, seed: int, per_class: bool = False) -> DataFrame:
    """Accuracy and macro (or per-class) precision, recall, F1 and AUROC of row resamples.

    A class without positives in a resample is left out of the averaged AUROC, and unknown per class."""
    probs = cut_lineage(probs)
    if draws.one_task(probs):
        c, zero = draws.class_draws(probs, row, levels, cols, replicates, seed), F.lit(0.0)
        per = c.select("rep", "label", F.coalesce(ratio("tp", "predicted"), zero).alias("precision"), F.coalesce(ratio("tp", "support"), zero).alias("recall"),
                       F.coalesce(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero).alias("f1"), "support", "tp", "auroc")
    else:
        d = probs.join(bootstrap_weights(probs.select(row), [], row, replicates, seed), [row])
        auc = one_vs_rest_auc(d, cols, ["rep"], "w")
        per = class_scores(confusion(d, cols, levels, ["rep"], "w"), levels, ["rep"]).join(auc, ["rep", "label"], "left")
    if per_class:
        some = F.col("support") > 0
        return per.select("rep", "label", *[F.when(some, F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "auroc")
    return per.groupBy("rep").agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                                  ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.avg("auroc").alias("auroc"))


def bootstrap_means(df: DataFrame, unit: str, values: dict[str, Column], replicates: int, seed: int) -> DataFrame:
    """(rep, weighted mean of each of `values`) of row resamples; equal draws for equal seeds, so that gaps are paired."""
    if draws.one_task(df):
        d = draws.weighted_sums(df, unit, values, replicates, seed)
        return d.select("rep", *[ratio(F.col(f"`{k}`"), F.col("w")).alias(k) for k in values])
    d = df.select(unit, *[c.cast("double").alias(k) for k, c in values.items()]).join(bootstrap_weights(df.select(unit), [], unit, replicates, seed), [unit])
    return d.groupBy("rep").agg(*[ratio(F.sum(F.col(f"`{k}`") * F.col("w")), F.sum("w")).alias(k) for k in values])


def bootstrap_median(df: DataFrame, unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Median of every resample of the rows.

    Rows beyond one task's are replaced by codes of their values: one by one near the median, as replicates' medians are
    there, and one code each below and above. Should a median be outside, the part coded one by one grows until none is."""
    if draws.one_task(df):
        return draws.median_draws(df, unit, value, replicates, seed)
    d = cut_lineage(df.select(F.struct(unit).alias("_u"), F.col(value).cast("double").alias("_v")))
    d = d.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    rows, units, known = d.agg(F.count(F.lit(1)), F.countDistinct("_u"), F.count("_v")).first()
    if units < rows or not known:
        w = bootstrap_weights(df.select(unit).distinct(), [], unit, replicates, seed)
        d = df.join(w, [unit]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
        return quantiles(d, ["rep"], value, [0.5]).select("rep", F.col("q")[0].alias("value"))
    d = cut_lineage(row_index(d.withColumn("_all", F.lit(1)), ["_all"], "_u", "_at").select("_at", "_v"))
    reach = REACH
    while True:
        off = reach * 0.5 / known ** 0.5 + 1e-4
        lo, hi = d.agg(F.percentile_approx("_v", [max(0.0, 0.5 - off), min(1.0, 0.5 + off)], 100_000)).first()[0]
        whole = off >= 0.5
        near = d if whole else d.filter(F.col("_v").between(lo, hi))
        values = row_index(near.filter("_v IS NOT NULL").select("_v").distinct().withColumn("_all", F.lit(1)), ["_all"], "_v", "_code")
        values = cut_lineage(values.select("_v", (F.col("_code") + 1).cast("int").alias("_code")))
        middle = values.count()
        coded = d.join(broadcast_if_small(values), ["_v"], "left").select("_at", F.coalesce(
            "_code", F.when(F.col("_v") < lo, 0).when(F.col("_v") > hi, middle + 1)).alias("_code"))
        got = cut_lineage(draws.middle_codes(coded, "_at", replicates, seed, middle))
        if whole or got.filter(f"lo = 0 OR hi = {middle + 1}").isEmpty():
            break
        reach *= 8
    low, high = (values.select(F.col("_code").alias(c), F.col("_v").alias(f"_{c}")) for c in ("lo", "hi"))
    return got.join(broadcast_if_small(low), ["lo"], "left").join(broadcast_if_small(high), ["hi"], "left").select(
        "rep", ((F.col("_lo") + F.col("_hi")) / 2).alias("value"))


def one_sided_p(boot: DataFrame, target: float | Column) -> DataFrame:
    """Share of draws at or above the target."""
    return boot.agg(F.avg(F.when(F.col("value") >= target, 1.0).otherwise(0.0)).alias("p_value"))


def mcnemar(df: DataFrame, a: str = "a", b: str = "b", with_p: bool = True) -> DataFrame:
    """Discordant counts, chi-square with Yates' correction, p-value."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    d = df.agg(n(F.col(a) & ~F.col(b)).alias("b"), n(~F.col(a) & F.col(b)).alias("c"))
    tot = F.col("b") + F.col("c")
    gap = F.abs(F.col("b") - F.col("c")) - 1
    d = d.withColumn("n_discordant", tot).withColumn(
        "chi2", F.when(tot == 0, 0.0).otherwise(F.try_divide((gap * gap).cast("double"), tot.cast("double"))))
    return d.withColumn("p_value", chi2_one_upper("chi2")) if with_p else d


def anova_from_summaries(df: DataFrame, unit: str, with_p: bool = True) -> DataFrame:
    """One-way ANOVA from (n, mean, sd) rows of a unit, and the range of the means."""
    n, m, s = F.col("n").cast("double"), F.col("mean"), F.col("sd")
    grand = df.groupBy(unit).agg((F.sum(n * m) / F.sum(n)).alias("_g"))
    d = df.join(broadcast_if_small(grand), [unit]).groupBy(unit).agg(
        F.sum(n * (m - F.col("_g")) * (m - F.col("_g"))).alias("_sb"), F.sum((n - 1) * s * s).alias("_sw"),
        (F.count(F.lit(1)) - 1).cast("double").alias("df_between"), F.sum(n).alias("_N"), (F.max(m) - F.min(m)).alias("mean_range"))
    d = d.withColumn("df_within", F.col("_N") - F.col("df_between") - 1).filter((F.col("df_within") > 0) & (F.col("_sw") > 0))
    d = d.withColumn("f", (F.col("_sb") / F.nullif("df_between", F.lit(0.0))) / (F.col("_sw") / F.col("df_within")))
    if with_p:
        d = d.withColumn("p_value", f_upper("f", "df_between", "df_within"))
    return d.drop("_sb", "_sw", "_N")


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Add `significant`: p is at most the largest p_(i) with p_(i) <= i / m * alpha."""
    d = rank_stats(df.withColumn("_all", F.lit(1)), ["_all"], p)
    last = F.col("_rank") + F.col("_ties") - 1  # the highest position among equal values
    cut = d.agg(F.max(F.when(F.col(p) <= last / F.col("_n") * F.lit(alpha), F.col(p))).alias("_cut"))
    return d.crossJoin(F.broadcast(cut)).withColumn(
        "significant", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_all", "_rank", "_ties", "_n", "_cut")


def paired_arms(df: DataFrame) -> DataFrame:
    """Share of answers that differ between two arms, and accuracy of the second minus the first."""
    hit = lambda c: F.avg(F.when(F.col(c) == F.col("truth"), 1.0).otherwise(0.0))
    return df.agg(F.avg(F.when(F.col("a") != F.col("b"), 1.0).otherwise(0.0)).alias("flip_rate"),
                  (hit("b") - hit("a")).alias("accuracy_delta"))


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(compared, differing) of two result tables: rows that one of them lacks, or whose values are not exactly equal."""
    keys, values = list(keys), list(values)
    left = a.select(*[F.col(c).alias(f"_a_{c}") for c in [*keys, *values]], F.lit(1).alias("_in_a"))
    right = b.select(*[F.col(c).alias(f"_b_{c}") for c in [*keys, *values]], F.lit(1).alias("_in_b"))
    on = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    equal = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    for v in values:
        equal = equal & F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))
    return left.join(right, on, "full").agg(F.count(F.lit(1)).alias("compared"), F.sum(F.when(equal, 0).otherwise(1)).cast("long").alias("differing"))


def rearranged(df: DataFrame, parts: int, unit: str) -> DataFrame:
    """The same rows in another order and partitioning, with units numbered anew in the same order (whole numbers only)."""
    d = df.withColumn(unit, F.col(unit) * 3 + 7)
    return d.repartition(parts, F.xxhash64(*d.columns)).sortWithinPartitions(F.desc(F.xxhash64(*d.columns)))
