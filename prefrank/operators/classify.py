"""Classification evaluation from class probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prefrank.operators.concordance import pair_totals
from prefrank.operators.metrics import ratio
from prefrank.operators.skew import group_load, running_total


def encoded(label: Column, order: Sequence[str]) -> Column:
    """Position in the fixed label order; an unknown label is an error."""
    out = F.raise_error(F.concat(F.lit("unknown label: "), label))
    for i, name in enumerate(order):
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out.cast("long")


def decoded(code: Column, order: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in order]), code.cast("int") + 1)


def argmax(probs: Sequence[Column]) -> Column:
    """Index of the first largest probability."""
    arr = F.array(*probs)
    return F.array_position(arr, F.array_max(arr)) - 1


def reordered(cols: Sequence[str], foreign: Sequence[str], order: Sequence[str]) -> list[Column]:
    """Probability columns given in a foreign label order, brought into ours."""
    at = {name: c for name, c in zip(foreign, cols)}
    return [F.col(at[name]).alias(f"prob_{name}") for name in order]


def _grid(df: DataFrame, levels: Sequence[int], names: Sequence[str]) -> DataFrame:
    g = df.sparkSession.createDataFrame([(int(v),) for v in levels], f"{names[0]} long")
    for n in names[1:]:
        g = g.crossJoin(df.sparkSession.createDataFrame([(int(v),) for v in levels], f"{n} long"))
    return F.broadcast(g)


def confusion(df: DataFrame, cols: Sequence[str], levels: Sequence[int], by: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    """(by, y_true, y_pred, n) with every cell of the label grid."""
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    cells = df.select(*by, F.col("y_true").cast("long").alias("y_true"), argmax([F.col(c) for c in cols]).alias("y_pred"),
                      *([weight] if weight else [])).groupBy(*by, "y_true", "y_pred").agg(n.alias("n"))
    grid = _grid(df, levels, ["y_true", "y_pred"])
    full = cells.select(*by).distinct().crossJoin(grid) if by else grid
    return full.join(cells, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(conf: DataFrame, levels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """C4: per class precision, recall, F1 (0 for 0/0) and support."""
    label = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(True).alias("row")),
                              F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("row")))).alias("_e")
    d = conf.select(*by, "n", (F.col("y_true") == F.col("y_pred")).alias("_hit"), label)
    row = F.col("_e.row")
    d = d.groupBy(*by, F.col("_e.label").alias("label")).agg(
        F.sum(F.when(row & F.col("_hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(row, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~row, F.col("n")).otherwise(0)).alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.filter(F.col("label").isin([int(v) for v in levels])).select(
        *by, "label", zero(ratio("tp", "predicted")).alias("precision"), zero(ratio("tp", "support")).alias("recall"),
        zero(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"), "support", "tp")


def macro_scores(per: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C4: accuracy, macro averages and support-weighted F1."""
    return per.groupBy(*by).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def one_vs_rest_auc(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, label, auroc), ties in probability one half; NULL for a class without both outcomes."""
    by = list(by)
    long = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("label"), F.col(c).alias("p"))
                               for i, c in enumerate(cols)])).alias("_e")
    d = df.select(*by, "y_true", *([weight] if weight else []), long).select(
        *by, F.col("_e.label").alias("label"), (F.col("y_true") == F.col("_e.label")).cast("double").alias("hit"),
        F.col("_e.p").alias("p"), *([weight] if weight else []))
    t = pair_totals(d, [*by, "label"], "hit", "p", weight, 0.0)
    good = F.col("same_way") + (F.col("ties_y") - F.col("ties_xy")) / 2
    return t.select(*by, "label", ratio(good, F.col("n_pairs") - F.col("ties_x")).alias("auroc"))


def calibration_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Per right-closed confidence bin the rows, mean confidence and accuracy of the top label."""
    arr = F.array(*[F.col(c) for c in cols])
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    d = df.select(F.array_max(arr).alias("conf"),
                  F.when(F.array_position(arr, F.array_max(arr)) - 1 == F.col("y_true"), 1.0).otherwise(0.0).alias("hit"))
    d = d.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("conf"))).cast("long")).filter("bin > 0")
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("confidence"), F.avg("hit").alias("accuracy"))


def expected_calibration_error(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Gap of accuracy and confidence averaged over bins by their share of all rows."""
    b = calibration_bins(df, cols, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return b.agg(gap.alias("_gap")).crossJoin(total).select(ratio("_gap", "_total").alias("ece"))


def roc_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(label, threshold, tpr, fpr) at every distinct probability of a class."""
    long = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("label"), F.col(c).alias("p"))
                               for i, c in enumerate(cols)])).alias("_e")
    d = df.select("y_true", long).select(F.col("_e.label").alias("label"), (-F.col("_e.p")).alias("_np"),
                                         (F.col("y_true") == F.col("_e.label")).cast("long").alias("hit"))
    d = d.groupBy("label", "_np").agg(F.sum("hit").alias("_tp"), F.sum(1 - F.col("hit")).alias("_fp"))
    _, largest = group_load(d, ["label"])
    tot = d.groupBy("label").agg(F.sum("_tp").alias("_P"), F.sum("_fp").alias("_N"))
    d = running_total(running_total(d, ["label"], "_np", "_tp", "_ctp", largest), ["label"], "_np", "_fp", "_cfp", largest)
    return d.join(F.broadcast(tot), "label").select(
        "label", (-F.col("_np")).alias("threshold"), ratio("_ctp", "_P").alias("tpr"), ratio("_cfp", "_N").alias("fpr"))


def competition_macro_f1(answers: DataFrame, solution: DataFrame, key: str, levels: Mapping[str, int]) -> DataFrame:
    """Macro F1 over the solution's labels; a missing, extra or unknown answer is an error."""
    from prefrank.operators.pairs import matched_submission

    order = sorted(levels, key=levels.get)
    d = matched_submission(answers, solution, key).select(
        encoded(F.col("truth"), order).alias("y_true"), encoded(F.col("answer"), order).alias("y_pred"))
    cells = d.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    per = class_scores(cells, list(levels.values()))
    return per.agg((F.sum("f1") / F.lit(float(len(order)))).alias("macro_f1"))
