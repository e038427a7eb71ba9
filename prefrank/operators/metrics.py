"""Ranking metrics per group and over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefrank.operators.concordance import pair_totals
from prefrank.operators.skew import average_rank, group_load, join_keys, rank_stats
from prefrank.session import cut_lineage

TIE = 1e-10


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def _sizes(df: DataFrame, keys: Sequence[str], weight: str | None) -> DataFrame:
    n = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys).agg(n.alias("n"))


def pairwise_accuracy(df: DataFrame, keys: Sequence[str], truth: str = "true_score",
                      pred: str = "predicted_score", weight: str | None = None,
                      strict: bool = False, load: tuple[int, int] | None = None) -> DataFrame:
    """M1: (keys, correct, pairs, pairwise_accuracy). A tie in truth or prediction earns one half;
    any other pair with an unknown score counts as wrong. `strict` (M11) leaves exact truth ties out."""
    keys = list(keys)
    t = pair_totals(df, keys, truth, pred, weight, 0.0 if strict else TIE, load, complete=strict)
    if strict:
        correct = F.col("same_way") + (F.col("ties_y") - F.col("ties_xy")) / 2
        out = t.select(*keys, correct.alias("correct"), (F.col("n_pairs") - F.col("ties_x")).alias("pairs"))
    else:
        correct = F.col("same_way") + (F.col("ties_x") + F.col("ties_y") - F.col("ties_xy")) / 2
        sizes = _sizes(df, keys, weight)
        out = join_keys(sizes, t, keys, "left").select(
            *keys, F.coalesce(correct, F.lit(0.0)).alias("correct"),
            (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return out.withColumn("pairwise_accuracy", ratio("correct", "pairs"))


def kendall_tau(df: DataFrame, keys: Sequence[str], truth: str = "true_score",
                pred: str = "predicted_score") -> DataFrame:
    """M3: tau-b over pairwise complete rows, exact ties."""
    keys = list(keys)
    t = pair_totals(df, keys, truth, pred, None, 0.0)
    disc = F.col("n_pairs") - F.col("ties_x") - F.col("ties_y") + F.col("ties_xy") - F.col("same_way")
    norm = F.sqrt((F.col("n_pairs") - F.col("ties_x")) * (F.col("n_pairs") - F.col("ties_y")))
    tau = t.select(*keys, ratio(F.col("same_way") - disc, norm).alias("kendall_tau"))
    return join_keys(df.select(*keys).distinct(), tau, keys, "left")


def spearman(df: DataFrame, keys: Sequence[str], truth: str = "true_score",
             pred: str = "predicted_score") -> DataFrame:
    """M2: correlation of average ranks over pairwise complete rows; NULL if undefined."""
    keys = list(keys)
    d = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(
        *keys, F.col(truth).alias("_t"), F.col(pred).alias("_p"))
    load = group_load(d, keys)
    d = rank_stats(rank_stats(d, keys, "_t", "_a_", load=load), keys, "_p", "_b_", load=load)
    # Ranks of n values average (n + 1) / 2, ties included: centre first, then sum.
    a = average_rank("_a_") - (F.col("_a_n") + 1) / F.lit(2.0)
    b = average_rank("_b_") - (F.col("_b_n") + 1) / F.lit(2.0)
    rho = (
        d.groupBy(*keys).agg(F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"))
        .select(*keys, ratio(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias("spearman"))
    )
    return join_keys(df.select(*keys).distinct(), rho, keys, "left")


def recall_at(df: DataFrame, keys: Sequence[str], ks: Sequence[int] = (1, 2, 3),
              truth: str = "true_score", pred: str = "predicted_score") -> DataFrame:
    """M4: expected chance that the best item is among the k best predicted, ties broken at random.

    Several best items: the one with the lowest prediction counts (canonical order)."""
    keys = list(keys)
    best = df.groupBy(*keys).agg(
        F.max(F.struct(F.col(truth).alias("t"), (-F.col(pred)).alias("p"))).alias("_b")
    ).select(*keys, (-F.col("_b.p")).alias("_best"))
    d = join_keys(df, best, keys)
    above = F.sum(F.when(F.col(pred) > F.col("_best") + TIE, 1).otherwise(0))
    tied = F.sum(F.when(F.abs(F.col(pred) - F.col("_best")) < TIE, 1).otherwise(0))
    d = d.groupBy(*keys).agg(above.alias("_above"), tied.alias("_tied"))
    cols = [
        F.when(F.col("_above") >= k, 0.0)
        .otherwise(ratio(F.least(F.lit(k) - F.col("_above"), F.col("_tied")), F.col("_tied")))
        .alias(f"recall_at_{k}") for k in ks
    ]
    return d.select(*keys, *cols)


def category_metrics(df: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """M5: one row per category with every ranking metric."""
    keys = list(keys)
    df = cut_lineage(df.select(*keys, "true_score", "predicted_score"))  # every metric reads it again
    acc = pairwise_accuracy(df, keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_products"))
    for part in (spearman(df, keys), kendall_tau(df, keys), acc, recall_at(df, keys)):
        n = join_keys(n, part, keys)
    return n.withColumnsRenamed({"correct": "correct_pairs", "pairs": "total_pairs"})


def overall_metrics(per_category: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlations weighted by items, accuracy by pairs, recall averaged over categories."""
    n = F.col("n_products")

    def weighted(c: str) -> Column:
        known = F.col(c).isNotNull()
        return ratio(F.sum(F.col(c) * n), F.sum(F.when(known, n))).alias(c)

    return per_category.groupBy(*by).agg(
        weighted("spearman"), weighted("kendall_tau"),
        ratio(F.sum("correct_pairs"), F.sum("total_pairs")).alias("pairwise_accuracy"),
        *[F.avg(f"recall_at_{k}").alias(f"recall_at_{k}") for k in (1, 2, 3)])


def micro_macro(acc: DataFrame, by: Sequence[str]) -> DataFrame:
    """M6: pooled accuracy, category average, and their difference."""
    d = acc.groupBy(*by).agg(ratio(F.sum("correct"), F.sum("pairs")).alias("micro"),
                             F.avg("pairwise_accuracy").alias("macro"))
    return d.withColumn("delta", F.col("macro") - F.col("micro"))


def partial_pooled(acc: DataFrame, by: Sequence[str]) -> DataFrame:
    """M7: DerSimonian-Laird random-effects pooling of category accuracies."""
    by = list(by)
    p, n = F.col("pairwise_accuracy"), F.col("pairs")
    edge = F.lit(0.5) / n
    pc = F.greatest(F.least(p, F.lit(1.0) - edge), edge)
    d = acc.filter(n > 0).select(*by, p.alias("p"), (pc * (F.lit(1.0) - pc) / n).alias("v"))
    w = F.lit(1.0) / F.col("v")
    fixed = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"),
        F.sum(w * F.col("p")).alias("swp"), F.sum(w * F.col("p") * F.col("p")).alias("swpp"))
    q = F.col("swpp") - F.col("swp") * F.col("swp") / F.col("sw")
    tau2 = F.greatest(F.lit(0.0), F.coalesce(
        ratio(q - (F.col("k") - 1), F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0)))
    fixed = fixed.select(*by, tau2.alias("tau2"))
    e = d.join(F.broadcast(fixed), by) if by else d.crossJoin(fixed)
    rw = F.lit(1.0) / (F.col("v") + F.col("tau2"))
    mean = e.groupBy(*by).agg((F.sum(rw * F.col("p")) / F.sum(rw)).alias("re_mean"))
    e = e.join(F.broadcast(mean), by) if by else e.crossJoin(mean)
    shrunk = (F.col("tau2") * F.col("p") + F.col("v") * F.col("re_mean")) / (F.col("tau2") + F.col("v"))
    return e.groupBy(*by).agg(F.max("tau2").alias("tau2"), F.max("re_mean").alias("re_mean"),
                              F.avg(shrunk).alias("partial_pooled"))


def exclusion_sweep(df: DataFrame, acc: DataFrame, by: Sequence[str], thresholds: Sequence[int]) -> DataFrame:
    """M8: micro and macro accuracy over categories of at least t items, for every t."""
    n = df.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n_items"))
    kept = acc.join(n, [*by, "category"]).withColumn(
        "threshold", F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds])))
    return micro_macro(kept.filter(F.col("n_items") >= F.col("threshold")), [*by, "threshold"])


def random_recall(df: DataFrame, keys: Sequence[str], by: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Expected recall of a random order, min(k, n) / n averaged over categories."""
    n = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(
        *[F.avg(F.least(F.lit(k), F.col("n")) / F.col("n")).alias(f"random_recall_at_{k}") for k in ks])


def submission_agreement(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Share of equal answers and Cohen's kappa of two answer columns with values 1 and 2."""
    one_a = F.avg(F.when(F.col(a) == 1, 1.0).otherwise(0.0))
    one_b = F.avg(F.when(F.col(b) == 1, 1.0).otherwise(0.0))
    d = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                            F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("agreement"),
                            one_a.alias("_a"), one_b.alias("_b"))
    expected = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    kappa = F.when(expected == 1.0, 1.0).otherwise(ratio(F.col("agreement") - expected, F.lit(1.0) - expected))
    return d.select(*by, "n", "agreement", kappa.alias("kappa"))


def scheme_correlation(board: DataFrame, a: str, b: str) -> DataFrame:
    """M9: rank correlation between two orderings of the models (one row per model)."""
    return spearman(board.withColumn("_all", F.lit(1)), ["_all"], a, b).select("spearman")


def leaderboard_overlap(ci: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per column of the board, the leader and who overlaps with its interval."""
    w = W.partitionBy(*by).orderBy(F.col("point").desc(), F.col("model"))
    lead = ci.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        *by, F.col("model").alias("leader"), F.col("lo").alias("_llo"), F.col("hi").alias("_lhi"))
    d = ci.join(lead, list(by))
    hit = F.coalesce(F.greatest("lo", "_llo") <= F.least("hi", "_lhi"), F.lit(False))
    return d.withColumn("is_leader", F.col("model") == F.col("leader")).withColumn(
        "overlaps", hit & ~F.col("is_leader")).drop("_llo", "_lhi")


def model_delta(board: DataFrame, control: str, by: Sequence[str], metric: str) -> DataFrame:
    """Metric of each model minus the metric of the control model."""
    base = board.filter(F.col("model") == control).select(*by, F.col(metric).alias("_base"))
    d = board.join(base, list(by)) if by else board.crossJoin(F.broadcast(base))
    return d.withColumn("delta", F.col(metric) - F.col("_base")).drop("_base")
