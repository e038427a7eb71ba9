"""Scaling, imputation and projection that are fitted on some rows and applied to others.

A fitted state is a table: a row per key with the number of rows, shift, scale and, for wide vectors, the
principal components of the scaled values. All of it follows from moments (n, mean, covariance), which are
summed once around a common centre; the moments of "all rows but this fold" are the total less the fold's, so
every fold is transformed by a state its own rows had no part in, without reading the others again. Leaving out
one row at a time takes a rank-one change of the total in the task that holds the row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prefrank.operators.features import quantiles
from prefrank.operators.skew import broadcast_if_small, join_keys
from prefrank.session import cut_lineage

STATE = "n long, shift array<double>, scale array<double>, centre array<double>, axes array<array<double>>"
SCALERS = ("none", "standard", "minmax", "robust")


@dataclass(frozen=True)
class Plan:
    """What is fitted. Vectors longer than `wide` are projected on `k` components, or as many as explain `variance`.

    With `scale_last` vectors are projected unscaled and the components scaled afterwards.
    """

    scaler: str = "standard"
    variance: float | None = 0.95
    k: int | None = None
    wide: int = 10
    scale_last: bool = False

    def __post_init__(self):
        if self.scaler not in SCALERS:
            raise ValueError(f"scaler {self.scaler!r}; one of {SCALERS}")


def principal_axes(cov: np.ndarray, n: float, variance: float | None, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(axes as rows, variances) by falling variance; the largest entry of each axis is positive."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    most = max(1, min(len(values), int(n)))
    if k is None:
        share = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(len(values))
        k = int(np.searchsorted(share, (1.0 if variance is None else variance) - 1e-12)) + 1
    axes = vectors[:min(k, most)]
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return axes, values[:len(axes)]


def state_of(n: float, mean: np.ndarray, cov: np.ndarray, plan: Plan, shift: np.ndarray | None = None, scale: np.ndarray | None = None) -> tuple:
    """(shift, scale, centre, axes) from the moments of the rows a state is fitted on; axes is None without projection.

    `shift` and `scale` are given for scalers that moments do not hold. A scale of zero is read as one.
    """
    if plan.scaler == "none" or plan.scale_last:
        shift, scale = np.zeros(len(mean)), np.ones(len(mean))
    elif plan.scaler == "standard":
        shift, scale = mean, np.sqrt(np.maximum(np.diag(cov), 0))
    # what is left of a constant after centring and subtraction is rounding
    scale = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(mean)), scale, 1.0)
    if len(mean) <= plan.wide:
        if plan.scale_last and plan.scaler == "standard":
            deviation = np.sqrt(np.maximum(np.diag(cov), 0))
            return mean, np.where(deviation > 1e-12 * np.maximum(1.0, np.abs(mean)), deviation, 1.0), np.zeros(len(mean)), None
        return shift, scale, np.zeros(len(mean)), None
    axes, values = principal_axes(cov / np.outer(scale, scale), n, plan.variance, plan.k)
    if plan.scale_last and plan.scaler == "standard":
        axes = axes / np.where(values > 1e-24, np.sqrt(values), 1.0)[:, None]
    return shift, scale, (mean - shift) / scale, axes


def applied(v: np.ndarray, state: tuple) -> np.ndarray:
    shift, scale, centre, axes = state
    z = (v - shift) / scale
    return z if axes is None else (z - centre) @ axes.T


def _vectors(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype(float)


def moments(df: DataFrame, keys: Sequence[str], vec: str, centre: np.ndarray) -> DataFrame:
    """(keys, n, s, ss): rows, sums and cross products (row by row in one array) of vectors less `centre`, per key.

    Tasks add up their own rows before anything is shuffled, so a key may hold any number of rows.
    """
    keys = list(keys)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "n double", "s array<double>", "ss array<double>"])
    held = 64  # keys kept apart in a task before they are handed on

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, v[0], v[1], v[2].ravel()) for k, v in sums.items()], columns=[*keys, "n", "s", "ss"])

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                v = _vectors(part, vec) - centre
                if key not in sums:
                    sums[key] = [0.0, np.zeros(len(centre)), np.zeros((len(centre), len(centre)))]
                acc = sums[key]
                acc[0] += len(v)
                acc[1] += v.sum(0)
                acc[2] += v.T @ v
            if len(sums) > held:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1]
        total = [np.sort(np.stack(pdf[c].to_numpy()), axis=0).sum(0) for c in ("s", "ss")]
        return pd.DataFrame({**{k: first[k].to_numpy() for k in keys}, "n": [pdf["n"].sum()], "s": [total[0]], "ss": [total[1]]})

    known = df.select(*keys, F.col(vec).cast("array<double>").alias(vec)).where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)))
    parts = known.mapInPandas(partial, schema)
    return parts.groupBy(*keys).applyInPandas(added, schema)


def column_centre(df: DataFrame, vec: str) -> np.ndarray | None:
    """Means per position, the centre of all sums; None without rows."""
    rows = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.avg(F.when(~F.isnan("x"), F.col("x"))).alias("m")).orderBy("pos").collect()
    return np.array([r["m"] or 0.0 for r in rows]) if rows else None


def _spread(df: DataFrame, vec: str, scaler: str) -> tuple[np.ndarray, np.ndarray]:
    d = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    if scaler == "minmax":
        rows = d.groupBy("pos").agg(F.min("x").alias("a"), (F.max("x") - F.min("x")).alias("b")).orderBy("pos").collect()
    else:
        rows = quantiles(d, ["pos"], "x", [.25, .5, .75]).select("pos", F.col("q")[1].alias("a"), (F.col("q")[2] - F.col("q")[0]).alias("b")).orderBy("pos").collect()
    return np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])


def fit(train: DataFrame, vec: str, plan: Plan = Plan()) -> DataFrame:
    """The state of all rows of `train`, a table of one row; no row if there are none.

    Vectors that are null or hold unknown entries take no part.
    """
    spark = train.sparkSession
    centre = column_centre(train, vec)
    if centre is None:
        return spark.createDataFrame([], STATE)
    m = moments(train, [], vec, centre).first()
    if m is None:
        return spark.createDataFrame([], STATE)
    n, s = m["n"], np.array(m["s"]) / m["n"]
    cov = np.array(m["ss"]).reshape(len(centre), -1) / n - np.outer(s, s)
    given = _spread(train, vec, plan.scaler) if plan.scaler in ("minmax", "robust") and not plan.scale_last else (None, None)
    shift, scale, middle, axes = state_of(n, centre + s, cov, plan, *given)
    row = (int(n), shift.tolist(), scale.tolist(), middle.tolist(), None if axes is None else axes.tolist())
    return spark.createDataFrame([row], STATE)


def fold_states(df: DataFrame, fold: str, vec: str, plan: Plan = Plan()) -> DataFrame:
    """(fold, state) of every fold, fitted on the rows of all others: total moments less the fold's.

    Standard scaling or none. A fold without rows outside it has no state.
    """
    if plan.scaler in ("minmax", "robust"):
        raise ValueError("fold states follow from moments; ranges and quantiles do not")
    centre = column_centre(df, vec)
    schema = f"`{fold}` {df.schema[fold].dataType.simpleString()}, {STATE}"
    if centre is None:
        return df.sparkSession.createDataFrame([], schema)
    per = cut_lineage(moments(df, [fold], vec, centre))
    total = moments(df, [], vec, centre).first()
    n, s, ss = total["n"], np.array(total["s"]), np.array(total["ss"])

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, m, own, products in zip(pdf[fold], pdf["n"], pdf["s"], pdf["ss"]):
                rest = n - m
                if rest > 0:
                    mean = (s - own) / rest
                    cov = (ss - products).reshape(len(s), -1) / rest - np.outer(mean, mean)
                    shift, scale, middle, axes = state_of(rest, centre + mean, cov, plan)
                    out.append((key, int(rest), shift, scale, middle, None if axes is None else list(axes)))
            yield pd.DataFrame(out, columns=[fold, "n", "shift", "scale", "centre", "axes"])

    return per.mapInPandas(states, schema)


def transform(df: DataFrame, state: DataFrame, vec: str, keys: Sequence[str] = ()) -> DataFrame:
    """Apply a state to vectors: with `keys`, the state of the row's key. Rows without a state, or with unknown entries, get NULL.

    States are sent to every task if their counted bytes are few; otherwise rows and states meet by key.
    """
    keys = list(keys)
    names = [F.col(f"`{c}`") for c in df.columns if c != vec]
    v = F.col(vec).cast("array<double>")
    renamed = state.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("shift", "scale", "centre", "axes")])
    d = join_keys(df, broadcast_if_small(renamed), keys, "left") if keys else df.join(F.broadcast(renamed), how="left")  # one row
    z = F.zip_with(F.zip_with(v, "__shift", lambda x, y: x - y), "__scale", lambda x, y: x / y)
    shifted = F.zip_with(z, "__centre", lambda x, y: x - y)
    dot = lambda axis: F.aggregate(F.zip_with(shifted, axis, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    unknown = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    value = F.when(F.col("__shift").isNull() | unknown, F.lit(None).cast("array<double>")).when(F.col("__axes").isNull(), z).otherwise(F.transform("__axes", dot))
    return d.select(*names, value.alias(vec))


def leave_one_out(df: DataFrame, vec: str, plan: Plan = Plan()) -> DataFrame:
    """Every row transformed by the state of all other rows. No shuffle: each task changes the total by its own rows.

    NULL for rows with unknown entries, and for a row that is the only one.
    """
    if plan.scaler in ("minmax", "robust"):
        raise ValueError("leaving out rows follows from moments; ranges and quantiles do not")
    df = df.withColumn(vec, F.col(vec).cast("array<double>"))
    centre = column_centre(df, vec)
    total = moments(df, [], vec, centre).first() if centre is not None else None
    if total is None:
        return df.withColumn(vec, F.lit(None).cast("array<double>"))
    n, s, ss = total["n"], np.array(total["s"]), np.array(total["ss"]).reshape(len(centre), -1)

    @F.pandas_udf("array<double>")
    def apply(rows: pd.Series) -> pd.Series:
        out = []
        for v in rows:
            x = None if v is None else np.array([np.nan if e is None else e for e in v], float)
            if x is None or np.isnan(x).any() or n < 2:
                out.append(None)
                continue
            own = x - centre
            mean = (s - own) / (n - 1)
            cov = (ss - np.outer(own, own)) / (n - 1) - np.outer(mean, mean)
            out.append(applied(x, state_of(n - 1, centre + mean, cov, plan)))
        return pd.Series(out)

    return df.withColumn(vec, apply(F.col(vec)))


def fold_means(df: DataFrame, fold: str, vec: str) -> DataFrame:
    """(fold, means) per position over the rows of all other folds; NULL where those hold no value."""
    d = df.select(fold, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    per = cut_lineage(d.groupBy(fold, "pos").agg(F.sum("x").alias("s"), F.count("x").alias("c")))
    total = per.groupBy("pos").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    every = df.select(fold).distinct().crossJoin(broadcast_if_small(total))  # a row per fold and position
    mine = join_keys(every, per, [fold, "pos"], "left").withColumn("m", F.try_divide(F.col("ts") - F.coalesce("s", F.lit(0.0)), F.col("tc") - F.coalesce("c", F.lit(0))))
    packed = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return mine.groupBy(fold).agg(packed.alias("_p")).select(fold, F.col("_p.m").alias("means"))


def impute_held_out(df: DataFrame, fold: str, vec: str) -> DataFrame:
    """P4 without leakage: unknown entries take the mean of their position over the other folds."""
    d = join_keys(df, broadcast_if_small(fold_means(df, fold, vec).withColumnRenamed("means", "__m")), [fold], "left")
    filled = F.zip_with(F.col(vec).cast("array<double>"), "__m", lambda x, y: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), y))
    return d.withColumn(vec, filled).drop("__m")
