"""Tail probabilities Spark SQL has no function for, as Arrow-batched column functions.

They run on small result tables (one row per model, unit or pair weight), not on raw rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) of Student's t."""
    return pd.Series(beta_tail(df / 2, np.full(len(t), 0.5), df / (df + t * t)), index=t.index)


@pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F > f)."""
    return pd.Series(beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)), index=f.index)


@pandas_udf(DoubleType())
def chi2_one_upper(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > x)."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if pd.notna(v) else None)


@pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    nd = NormalDist()
    return p.map(lambda v: nd.inv_cdf(v) if pd.notna(v) and 0 < v < 1 else
                 (math.inf if v == 1 else -math.inf if v == 0 else None))


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if pd.notna(v) else None)
