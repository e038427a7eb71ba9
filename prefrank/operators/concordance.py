"""Counts over all pairs of a group without building the pairs.

Pairwise accuracy, Kendall tau and their resampled forms only need five totals per group: all
pairs, pairs tied in x, in y, in both, and pairs ordered the same way in both. Ties are plain
grouped counts. Same-way pairs are counted by a radix descent over sorted arrays, for many groups
per task. A group too large for one task is cut into strips of x and of y: strip cells, rows
sharing an x strip, and rows sharing a y strip then hold every same-way pair exactly once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from prefrank.operators.skew import add_strip, cut_points, group_load, join_keys, running_total
from prefrank.session import cut_lineage, group_rows

TOTALS = ("n_pairs", "ties_x", "ties_y", "ties_xy", "same_way")


def _classes(gid: np.ndarray, v: np.ndarray, tol: float) -> np.ndarray:
    """Rising tie-class numbers over all groups; neighbours closer than `tol` share one."""
    order = np.lexsort((v, gid))
    g, s = gid[order], v[order]
    gap = np.diff(s)
    new = np.ones(len(v), dtype=bool)
    new[1:] = (np.diff(g) != 0) | ((gap >= tol) if tol > 0 else (gap > 0))
    out = np.empty(len(v), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _pairs_within(cls: np.ndarray, gid: np.ndarray, w: np.ndarray, groups: int) -> np.ndarray:
    """Per group, the weighted pairs whose two members share a class."""
    _, first, inv = np.unique(cls, return_index=True, return_inverse=True)
    s = np.bincount(inv, weights=w)
    return np.bincount(gid[first], weights=s * (s - 1) / 2, minlength=groups)


def same_way_pairs(gid: np.ndarray, cx: np.ndarray, cy: np.ndarray, w: np.ndarray, groups: int) -> np.ndarray:
    """Per group, the weighted pairs with x_i < x_j and y_i < y_j (classes rise with gid)."""
    total = np.zeros(groups)
    if len(gid) < 2:
        return total
    by_x = np.lexsort((-cy, cx))
    rank_y = np.empty(len(gid), dtype=np.int64)
    rank_y[np.lexsort((-cx, cy))] = np.arange(len(gid))
    g, b, ww = gid[by_x], rank_y[by_x], w[by_x].astype(np.float64)
    start = np.zeros(groups, dtype=np.int64)
    sizes = np.bincount(g, minlength=groups)
    start[1:] = np.cumsum(sizes)[:-1]
    b = b - start[g]
    bits = int(sizes.max() - 1).bit_length()
    for level in range(bits - 1, -1, -1):
        # Rows are ordered by (group, higher bits of b), then by x.
        one = (b >> level) & 1
        head = (g << bits) | (b >> (level + 1))
        low = np.where(one == 0, ww, 0.0)
        before = np.cumsum(low) - low
        first = np.ones(len(g), dtype=bool)
        first[1:] = head[1:] != head[:-1]
        seg = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        total += np.bincount(g, weights=np.where(one == 1, ww * (before - before[seg]), 0.0), minlength=groups)
        nxt = np.argsort((g << bits) | (b >> level), kind="stable")
        g, b, ww = g[nxt], b[nxt], ww[nxt]
    return total


def same_way_partners(gid: np.ndarray, cx: np.ndarray, cy: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per row, the weight of rows of its group ordered the same way to it in x and in y."""
    n = len(gid)
    out = np.zeros(n)
    if n < 2:
        return out
    by_x = np.lexsort((-cy, cx))
    rank_y = np.empty(n, dtype=np.int64)
    # Equal points run in opposite directions in the two orders, so they never count as ordered.
    rank_y[np.lexsort((-np.arange(n), -cx, cy))] = np.arange(n)
    at, g, b, ww = by_x, gid[by_x], rank_y[by_x], w[by_x].astype(np.float64)
    sizes = np.bincount(gid)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    b = b - start[g]
    bits = int(sizes.max() - 1).bit_length()
    for level in range(bits - 1, -1, -1):
        one = ((b >> level) & 1).astype(bool)
        head = (g << bits) | (b >> (level + 1))
        first = np.ones(n, dtype=bool)
        first[1:] = head[1:] != head[:-1]
        seg = np.cumsum(first) - 1
        low, high = np.where(one, 0.0, ww), np.where(one, ww, 0.0)
        cl, ch = np.cumsum(low) - low, np.cumsum(high)
        heads = np.flatnonzero(first)
        lows_before = cl - cl[heads][seg]
        highs_total = np.add.reduceat(high, heads)[seg]
        highs_after = highs_total - (ch - (ch - high)[heads][seg])
        out[at] += np.where(one, lows_before, highs_after)
        nxt = np.argsort((g << bits) | (b >> level), kind="stable")
        at, g, b, ww = at[nxt], g[nxt], b[nxt], ww[nxt]
    return out


def dominance(ypos: np.ndarray, w: np.ndarray, ends: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Per query, the weight of points among the first `ends` (in order of x) whose place by y is under `below`.

    `ypos` holds the points' places by y in order of x. One pass a bit of the place, over all queries and
    all columns of `w` at once: points are split by the bit, a query follows its half and adds the other.
    """
    shape = (len(ends), *w.shape[1:])
    out, first, last = np.zeros(shape), np.zeros(len(ends), dtype=np.int64), np.asarray(ends, dtype=np.int64)
    place, weight = ypos, w.astype(np.float64)
    for level in range(len(ypos).bit_length() - 1, -1, -1):
        low = (place >> level) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(low)])
        sums = np.concatenate([np.zeros((1, *w.shape[1:])), np.cumsum(weight * low.reshape(-1, *[1] * (w.ndim - 1)), axis=0)])
        one = (below >> level) & 1 == 1
        out[one] += sums[last[one]] - sums[first[one]]
        first = np.where(one, zeros[-1] + first - zeros[first], zeros[first])
        last = np.where(one, zeros[-1] + last - zeros[last], zeros[last])
        split = np.argsort(~low, kind="stable")
        place, weight = place[split], weight[split]
    return out


def near_range(s: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values the first and the end of the places whose value differs by less than `tol`."""
    n = len(s)
    lo, hi = np.searchsorted(s, s - tol, "right"), np.searchsorted(s, s + tol, "left")
    at = np.arange(n)
    lo, hi = np.minimum(lo, at), np.maximum(hi, at + 1)
    # sums round; differences decide
    while (far := s - s[lo] >= tol).any():
        lo = lo + far
    while (near := (lo > 0) & (s - s[np.maximum(lo - 1, 0)] < tol)).any():
        lo = lo - near
    while (far := s[hi - 1] - s >= tol).any():
        hi = hi - far
    while (near := (hi < n) & (s[np.minimum(hi, n - 1)] - s < tol)).any():
        hi = hi + near
    return lo, hi


def _near_weight(v: np.ndarray, w: np.ndarray, tol: float) -> np.ndarray:
    """Per row the weight of rows (itself included) whose value differs by less than `tol`; 0 for unknown values."""
    out, known = np.zeros(w.shape), np.flatnonzero(~np.isnan(v))
    order = known[np.argsort(v[known], kind="stable")]
    lo, hi = near_range(v[order], tol)
    sums = np.concatenate([np.zeros((1, *w.shape[1:])), np.cumsum(w[order], axis=0)])
    out[order] = sums[hi] - sums[lo]
    return out


def near_partners(x: np.ndarray, y: np.ndarray, w: np.ndarray, tol: float) -> dict[str, np.ndarray]:
    """Per row of one group the weight of rows that are near it in x, in y, in both (itself included), and ordered

    the same way below or above it. Near means a difference under `tol`, for each pair on its own: values are
    never chained. `w` may have a column for each of many weightings.
    """
    out = {"x": _near_weight(x, w, tol), "y": _near_weight(y, w, tol), "xy": np.zeros(w.shape), "below": np.zeros(w.shape), "above": np.zeros(w.shape)}
    known = np.flatnonzero(~np.isnan(x) & ~np.isnan(y))
    if not len(known):
        return out
    at = known[np.argsort(x[known], kind="stable")]  # order of x
    n, ww = len(at), w[at]
    by_y = np.argsort(y[at], kind="stable")
    ypos = np.empty(n, dtype=np.int64)
    ypos[by_y] = np.arange(n)
    xlo, xhi = near_range(x[at], tol)
    ylo, yhi = (r[ypos] for r in near_range(y[at][by_y], tol))
    low = dominance(ypos, ww, xlo, ylo)
    high = dominance(ypos, ww, xhi, yhi)
    out["below"][at] = low
    out["xy"][at] = high - dominance(ypos, ww, xlo, yhi) - dominance(ypos, ww, xhi, ylo) + low
    in_x = np.concatenate([np.zeros((1, *w.shape[1:])), np.cumsum(ww, axis=0)])
    in_y = np.concatenate([np.zeros((1, *w.shape[1:])), np.cumsum(ww[by_y], axis=0)])
    out["above"][at] = in_x[-1] - in_x[xhi] - in_y[yhi] + high
    return out


def chained_groups(gid: np.ndarray, v: np.ndarray, cls: np.ndarray, tol: float) -> np.ndarray:
    """Groups where a tie class spans `tol` or more, so that being near is not the same as sharing a class."""
    if tol <= 0 or not len(v):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((v, cls))
    c, s = cls[order], v[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(c) != 0]))
    tails = np.append(heads[1:], len(c)) - 1
    return np.unique(gid[order][heads][s[tails] - s[heads] >= tol])


def group_totals(gid: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, groups: int,
                 tol: float) -> dict[str, np.ndarray]:
    """The five totals; ties in x (or y) count every row with x (or y) known, the rest needs both.

    Where tie classes chain values further apart than `tol`, each pair is judged on its own instead."""
    kx, ky = ~np.isnan(x), ~np.isnan(y)
    k = kx & ky
    out = {c: np.zeros(groups) for c in TOTALS}
    full_gid, full_w, chained = gid, w, []
    for known, v, name in ((kx, x, "ties_x"), (ky, y, "ties_y")):
        if known.any():
            cls = _classes(gid[known], v[known], tol)
            out[name] = _pairs_within(cls, gid[known], w[known], groups)
            chained.append(chained_groups(gid[known], v[known], cls, tol))
    if k.any():
        gid, w, cx, cy = gid[k], w[k], _classes(gid[k], x[k], tol), _classes(gid[k], y[k], tol)
        both = cx * (cy.max() + 1) + cy
        _, first, inv = np.unique(both, return_index=True, return_inverse=True)
        size = np.bincount(gid, weights=w, minlength=groups)
        out["n_pairs"] = size * (size - 1) / 2
        out["ties_xy"] = _pairs_within(both, gid, w, groups)
        out["same_way"] = same_way_pairs(gid[first], cx[first], cy[first], np.bincount(inv, weights=w), groups)
    for g in np.unique(np.concatenate(chained)) if chained else ():
        rows = np.flatnonzero(full_gid == g)
        ww = full_w[rows]
        near = near_partners(x[rows], y[rows], ww, tol)
        known = {"x": kx[rows], "y": ky[rows], "xy": k[rows]}
        for c, own in known.items():
            out[f"ties_{c}"][g] = (ww * (near[c] - own)).sum() / 2
        out["same_way"][g] = (ww * near["below"]).sum()
    return out


def _packed(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, total: int, tol: float) -> DataFrame:
    """All groups fit a task: pack them into buckets and count bucket by bucket."""
    keys = list(keys)
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
                       + [f"{c} double" for c in TOTALS])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby(keys, sort=False, dropna=False)
        gid = g.ngroup().to_numpy()
        heads = pdf.loc[~pd.Series(gid, index=pdf.index).duplicated(), keys].reset_index(drop=True)
        t = group_totals(gid, pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float),
                         pdf["_w"].to_numpy(float), len(heads), tol)
        return heads.assign(**t)

    return (
        df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                  F.col(w).cast("double").alias("_w"),
                  F.pmod(F.xxhash64(*keys), F.lit(_buckets(df, total))).alias("_bucket"))
        .groupBy("_bucket").applyInPandas(count, schema)
    )


def _tie_class(df: DataFrame, keys: Sequence[str], col: str, tol: float, out: str) -> DataFrame:
    """(keys, col, dense tie-class number) for groups of any size."""
    keys = list(keys)
    vals = df.select(*keys, col).dropna(subset=[col]).distinct()
    _, largest = group_load(vals, keys)
    d = add_strip(vals, keys, col, cut_points(vals, keys, col, largest), "_strip")
    edge = (
        d.groupBy(*keys, "_strip").agg(F.max(col).alias("_max"))
        .select(*keys, "_strip", F.lag("_max").over(W.partitionBy(*keys).orderBy("_strip")).alias("_edge"))
    )
    prev = F.coalesce(F.lag(col).over(W.partitionBy(*keys, "_strip").orderBy(col)), F.col("_edge"))
    step = (F.col(col) - F.col("_prev") >= tol) if tol > 0 else (F.col(col) > F.col("_prev"))
    flagged = (
        join_keys(d, edge, [*keys, "_strip"]).withColumn("_prev", prev)
        .select(*keys, col, F.when(F.col("_prev").isNull() | step, 1).otherwise(0).cast("long").alias("_new"))
    )
    return running_total(flagged, keys, col, "_new", out, largest).drop("_new")


def _strict(points: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Same-way pairs per group for weighted points of any group size; x, y are integers."""
    keys = list(keys)
    total, largest = group_load(points, keys)
    if largest <= group_rows(points.sparkSession):
        return _packed(points, keys, x, y, w, total, 0.0).select(*keys, "same_way")
    d = add_strip(points, keys, x, cut_points(points, keys, x, largest), "_xs")
    d = cut_lineage(add_strip(d, keys, y, cut_points(points, keys, y, largest), "_ys"))
    cells = d.groupBy(*keys, "_xs", "_ys").agg(F.sum(w).alias("_cw")).withColumnsRenamed({"_xs": "_cx", "_ys": "_cy"})
    across = _strict(cells, keys, "_cx", "_cy", "_cw")

    def inside(strip: str, px: str) -> DataFrame:
        # An odd strip holds one single value of its axis, so no pair in it can be ordered.
        rows = d.filter((F.col(strip) == 0) | (F.col(strip) % 2 == 0))
        n, _ = group_load(rows, [*keys, strip])
        return _packed(rows.select(*keys, strip, F.col(px).alias("_px"), y, w), [*keys, strip],
                       "_px", y, w, n, 0.0).select(*keys, "same_way")

    parts = across.unionByName(inside("_xs", x)).unionByName(inside("_ys", "_xs"))
    return parts.groupBy(*keys).agg(F.sum("same_way").alias("same_way"))


def pair_totals(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str | None = None,
                tol: float = 1e-10, load: tuple[int, int] | None = None, complete: bool = True) -> DataFrame:
    """Per group: n_pairs, ties_x, ties_y, ties_xy, same_way over rows where x and y are known.

    Without `complete`, ties_x (ties_y) also counts rows where only x (only y) is known.

    `weight` counts copies of a row; two copies of one row tie with each other in x and y.
    `load` is an upper bound of (all rows, rows of the largest group) if the caller knows one.
    """
    keys = list(keys)
    known = (F.col(x).isNotNull() & F.col(y).isNotNull()) if complete else (F.col(x).isNotNull() | F.col(y).isNotNull())
    d = df.filter(known).select(
        *keys, F.col(x).cast("double").alias("_tx"), F.col(y).cast("double").alias("_ty"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_tw"))
    total, largest = load or group_load(d, keys)
    limit = group_rows(df.sparkSession)
    if largest > limit:
        d = cut_lineage(d.groupBy(*keys, "_tx", "_ty").agg(F.sum("_tw").alias("_tw")))
        total, largest = group_load(d, keys)
    if largest <= limit:
        return _packed(d, keys, "_tx", "_ty", "_tw", total, tol)
    d = join_keys(join_keys(d, _tie_class(d, keys, "_tx", tol, "_px"), [*keys, "_tx"], "left"),
                  _tie_class(d, keys, "_ty", tol, "_py"), [*keys, "_ty"], "left")
    pts = cut_lineage(d.groupBy(*keys, "_px", "_py").agg(F.sum("_tw").alias("_tw")))

    full = pts.dropna(subset=["_px", "_py"])

    def tied(cols: list[str], out: str) -> DataFrame:
        s = F.col("_s")
        src = pts.dropna(subset=cols) if len(cols) == 1 else full
        return (src.groupBy(*keys, *cols).agg(F.sum("_tw").alias("_s"))
                .groupBy(*keys).agg(F.sum(s * (s - 1) / 2).alias(out)))

    out = pts.select(*keys).distinct()
    for part in (tied([], "n_pairs"), tied(["_px"], "ties_x"), tied(["_py"], "ties_y"), tied(["_px", "_py"], "ties_xy"),
                 _strict(full, keys, "_px", "_py", "_tw")):
        out = join_keys(out, part, keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in TOTALS])


def _buckets(df: DataFrame, total: int) -> int:
    return max(1, math.ceil(total / group_rows(df.sparkSession)),
               min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / 5000)))


def _packed_each(df: DataFrame, keys: Sequence[str], carry: Sequence[str], x: str, y: str, w: str,
                 total: int) -> DataFrame:
    """Per row (keys, carry), its same-way partners; every group fits a task; x and y are exact."""
    keys, carry = list(keys), list(carry)
    cols = list(dict.fromkeys([*keys, *carry]))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in cols) + ", same_way double"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        cx = _classes(gid, pdf["_x"].to_numpy(float), 0.0)
        cy = _classes(gid, pdf["_y"].to_numpy(float), 0.0)
        return pdf[cols].assign(same_way=same_way_partners(gid, cx, cy, pdf["_w"].to_numpy(float)))

    return (
        df.select(*cols, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                  F.col(w).cast("double").alias("_w"),
                  F.pmod(F.xxhash64(*keys), F.lit(_buckets(df, total))).alias("_bucket"))
        .groupBy("_bucket").applyInPandas(count, schema)
    )


def _strict_each(points: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """(keys, x, y, same_way) per weighted point, for groups of any size; (keys, x, y) is unique."""
    keys = list(keys)
    total, largest = group_load(points, keys)
    if largest <= group_rows(points.sparkSession):
        return _packed_each(points, keys, [x, y], x, y, w, total)
    d = add_strip(points, keys, x, cut_points(points, keys, x, largest), "_xs")
    d = cut_lineage(add_strip(d, keys, y, cut_points(points, keys, y, largest), "_ys"))
    cells = d.groupBy(*keys, "_xs", "_ys").agg(F.sum(w).alias("_cw")).withColumnsRenamed({"_xs": "_cx", "_ys": "_cy"})
    across = _strict_each(cells, keys, "_cx", "_cy", "_cw").withColumnsRenamed({"_cx": "_xs", "_cy": "_ys"})
    across = join_keys(d, across, [*keys, "_xs", "_ys"]).select(*keys, x, y, "same_way")

    def inside(strip: str, px: str) -> DataFrame:
        rows = d.filter((F.col(strip) == 0) | (F.col(strip) % 2 == 0))
        n, _ = group_load(rows, [*keys, strip])
        rows = rows.select(*keys, strip, x, y, F.col(px).alias("_inner"), w)
        return _packed_each(rows, [*keys, strip], [x, y], "_inner", y, w, n).select(*keys, x, y, "same_way")

    parts = across.unionByName(inside("_xs", x)).unionByName(inside("_ys", "_xs"))
    return parts.groupBy(*keys, x, y).agg(F.sum("same_way").alias("same_way"))


def _packed_credit(df: DataFrame, keys: list[str], x: str, y: str, tol: float, total: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", credit double"
    names = df.columns

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        vx, vy = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        kx, ky = ~np.isnan(vx), ~np.isnan(vy)
        k = kx & ky
        tied, chained = np.zeros(len(pdf)), []
        for known, v in ((kx, vx), (ky, vy)):
            if known.any():
                c = _classes(gid[known], v[known], tol)
                tied[known] += np.bincount(c)[c] - 1
                chained.append(chained_groups(gid[known], v[known], c, tol))
        credit = np.zeros(len(pdf))
        if k.any():
            cx, cy = _classes(gid[k], vx[k], tol), _classes(gid[k], vy[k], tol)
            _, both, nxy = np.unique(cx * (cy.max() + 1) + cy, return_inverse=True, return_counts=True)
            tied[k] -= nxy[both] - 1
            credit[k] = same_way_partners(gid[k], cx, cy, np.ones(int(k.sum())))
        credit += tied / 2
        for g in np.unique(np.concatenate(chained)) if chained else ():
            rows = np.flatnonzero(gid == g)
            near = near_partners(vx[rows], vy[rows], np.ones(len(rows)), tol)
            ties = (near["x"] - kx[rows]) + (near["y"] - ky[rows]) - (near["xy"] - k[rows])
            credit[rows] = near["below"] + near["above"] + ties / 2
        return pdf[names].assign(credit=credit)

    return (df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(_buckets(df, total))))
            .groupBy("_bucket").applyInPandas(count, schema))


def item_credit(df: DataFrame, keys: Sequence[str], x: str, y: str, tol: float = 1e-10) -> DataFrame:
    """Add `credit`: the sum over the other rows of the group of 1 for the same order in x and y,
    one half for a tie in either, 0 otherwise; an unknown value neither ties nor orders."""
    keys = list(keys)
    total, largest = group_load(df, keys)
    if largest <= group_rows(df.sparkSession):
        return _packed_credit(df, keys, x, y, tol, total)
    tx, ty = F.col(x).cast("double").alias("_tx"), F.col(y).cast("double").alias("_ty")
    pts = cut_lineage(df.select(*keys, tx, ty).groupBy(*keys, "_tx", "_ty").agg(F.count(F.lit(1)).cast("double").alias("_tw")))
    cls = join_keys(join_keys(pts, _tie_class(pts, keys, "_tx", tol, "_px"), [*keys, "_tx"], "left"),
                    _tie_class(pts, keys, "_ty", tol, "_py"), [*keys, "_ty"], "left")
    merged = cut_lineage(cls.groupBy(*keys, "_px", "_py").agg(F.sum("_tw").alias("_nxy")))
    full = merged.dropna(subset=["_px", "_py"])
    strict = _strict_each(full, keys, "_px", "_py", "_nxy")
    per = merged
    for c, out in (("_px", "_nx"), ("_py", "_ny")):
        others = merged.dropna(subset=[c]).groupBy(*keys, c).agg((F.sum("_nxy") - 1).alias(out))
        per = join_keys(per, others, [*keys, c], "left")
    per = join_keys(per, strict, [*keys, "_px", "_py"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    same = F.when(F.col("_px").isNotNull() & F.col("_py").isNotNull(), F.col("_nxy") - 1).otherwise(0.0)
    credit = zero("same_way") + (zero("_nx") + zero("_ny") - same) / 2
    per = per.select(*keys, F.col("_px").alias("_qx"), F.col("_py").alias("_qy"), credit.alias("_credit"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    per = per.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    out = cls.join(per, [*on, F.col("_px").eqNullSafe(F.col("_qx")), F.col("_py").eqNullSafe(F.col("_qy"))])
    out = out.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_tx").alias("_ux"), F.col("_ty").alias("_uy"), F.col("_credit").alias("credit"))
    d = df.withColumns({"_vx": F.col(x).cast("double"), "_vy": F.col(y).cast("double")})
    d = d.join(out, [*on, F.col("_vx").eqNullSafe(F.col("_ux")), F.col("_vy").eqNullSafe(F.col("_uy"))])
    return d.select(*df.columns, "credit")
