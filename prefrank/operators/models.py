"""Scoring models and ensembles.

Linear models are fitted from summed cross products: the table is read once, a (features + 1)
square matrix comes back, and leave-one-out predictions follow in closed form without refits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from prefrank.functions.hashing import hash32, uniform
from prefrank.operators.metrics import pairwise_accuracy, ratio
from prefrank.operators import pairwise_fit
from prefrank.operators.pairs import _tiled, align_models, band_rows
from prefrank.operators.ranking import add_rank_pct
from prefrank.operators.skew import group_load, spread

MAX_FEATURES = 4096
#: Numbers of all moments together, and the share of a sum that terms beyond them may reach, at which they stand for the pairs.
MOMENTS, SLACK = 1 << 20, 1e-10


def parameter_grid(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    """Cartesian product of parameter values (a handful of rows) with a hash of each setting."""
    out = None
    for name, vals in values.items():
        d = spark.createDataFrame([(v,) for v in vals], [name])
        out = d if out is None else out.crossJoin(d)
    return out.withColumn("config_hash", F.sha2(F.to_json(F.struct(*sorted(values))), 256))


def cross_products(df: DataFrame, vec: str, target: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(Z'Z, Z'y, y'y) of Z = [x, 1] over rows where both are known.

    Each partition sums its own products; the rows of the matrix are then added up in parallel.
    """
    def partial(batches):
        acc = None
        for pdf in batches:
            if len(pdf):
                z = np.column_stack([np.stack(pdf["v"].to_numpy()), np.ones(len(pdf)), pdf["y"].to_numpy()])
                acc = z.T @ z if acc is None else acc + z.T @ z
        if acc is not None:
            yield pd.DataFrame({"row": np.arange(len(acc)), "vals": list(acc)})

    d = df.select(F.col(vec).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y")).dropna()
    first = d.select(F.size("v").alias("n")).first()
    if first and first["n"] > MAX_FEATURES:
        raise ValueError(f"{first['n']} features, at most {MAX_FEATURES}; reduce them first (see features.projected)")
    parts = d.mapInPandas(partial, "row int, vals array<double>")
    rows = (parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("vals"))).alias("vals"))
            .orderBy("row").collect())
    g = np.array([r["vals"] for r in rows])
    return g[:-1, :-1], g[:-1, -1], float(g[-1, -1])


def _penalty(n: int, alpha: float) -> np.ndarray:
    d = np.full(n, alpha)
    d[-1] = 0.0  # the intercept is not penalised
    return np.diag(d)


def ridge_fit(df: DataFrame, vec: str, target: str, alpha: float = 1.0) -> np.ndarray:
    """Slopes and, last, the intercept."""
    zz, zy, _ = cross_products(df, vec, target)
    return np.linalg.solve(zz + _penalty(len(zz), alpha), zy)


def ridge_scores(df: DataFrame, vec: str, coef: np.ndarray, out: str = "predicted_score") -> DataFrame:
    w = F.array(*[F.lit(float(c)) for c in coef[:-1]])
    s = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), w, lambda x, y: x * y), F.lit(float(coef[-1])), lambda a, x: a + x)
    return df.withColumn(out, s)


def ridge_leave_one_out(df: DataFrame, vec: str, target: str, alpha: float = 1.0,
                        out: str = "predicted_score") -> DataFrame:
    """Prediction of each row by the model fitted on all other rows."""
    zz, zy, _ = cross_products(df, vec, target)
    inv = np.linalg.inv(zz + _penalty(len(zz), alpha))
    coef = inv @ zy
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"

    def predict(batches):
        for pdf in batches:
            z = np.column_stack([np.stack(pdf[vec].to_numpy()).astype(float), np.ones(len(pdf))]) if len(pdf) else np.zeros((0, len(coef)))
            h = np.einsum("ij,jk,ik->i", z, inv, z)
            y = pdf[target].to_numpy(float)
            yield pdf.assign(**{out: (z @ coef - h * y) / (1 - h)})

    return df.dropna(subset=[vec, target]).mapInPandas(predict, schema)


def _supports(k: int) -> list[tuple[int, ...]]:
    return [s for n in range(k, 0, -1) for s in combinations(range(k), n)]


def nnls_weights(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Non-negative least squares from stacked cross products g (n,k,k) and c (n,k): the best of
    all non-negative solutions on subsets of the few predictors."""
    n, k = c.shape
    best, weights = np.zeros(n), np.zeros((n, k))
    for s in _supports(k):
        ix = np.array(s)
        sub, rhs = g[:, ix[:, None], ix[None, :]], c[:, ix]
        ok = np.abs(np.linalg.det(sub)) > 1e-12 * np.prod(np.einsum("nii->ni", sub), axis=1)
        w = np.zeros((n, len(s)))
        w[ok] = np.linalg.solve(sub[ok], rhs[ok][:, :, None])[:, :, 0]
        gain = np.einsum("ni,ni->n", w, rhs)  # drop in squared error at the optimum
        take = ok & (w >= 0).all(axis=1) & (gain > best)
        best[take] = gain[take]
        weights[np.ix_(take, ix)] = w[take]
        weights[np.ix_(take, np.setdiff1d(np.arange(k), ix))] = 0.0
    return weights


def nnls_leave_one_out(df: DataFrame, cols: Sequence[str], target: str, out: str = "predicted_score") -> DataFrame:
    """Non-negative combination without intercept, fitted on all other rows; rows with an
    unknown input are left out of the fit and dropped."""
    cols = list(cols)
    d = df.dropna(subset=[*cols, target])
    pairs = [(a, b) for a in cols for b in cols]
    sums = d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)],
                 *[F.sum(F.col(a) * F.col(target)).alias(f"c{i}") for i, a in enumerate(cols)]).first()
    k = len(cols)
    g = np.array([sums[f"g{i}"] or 0.0 for i in range(k * k)]).reshape(k, k)
    c = np.array([sums[f"c{i}"] or 0.0 for i in range(k)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + f", `{out}` double"

    def predict(batches):
        for pdf in batches:
            x, y = pdf[cols].to_numpy(float), pdf[target].to_numpy(float)
            w = nnls_weights(g[None] - x[:, :, None] * x[:, None, :], c[None] - x * y[:, None])
            yield pdf.assign(**{out: (w * x).sum(axis=1)})

    return d.mapInPandas(predict, schema)


class LeftOut:
    """Rows of views as leave-two-out predictions need them: z, its product with the fit's inverse, leverage h,
    s = 1 / (1 - h), residual e and prediction q of the fit without the row."""

    def __init__(self, pdf: pd.DataFrame, vecs: Sequence[str], fits: Mapping[str, tuple[np.ndarray, np.ndarray]]):
        self.y, views = pdf["_y"].to_numpy(), []
        for v in vecs:
            inv, coef = fits[v]
            z = np.column_stack([np.stack(pdf[v].to_numpy()), np.ones(len(pdf))])
            u = z @ inv
            h = (u * z).sum(1)
            s = 1 / (1 - h)
            e = (self.y - z @ coef) * s
            views.append((z, u, h, s, e, self.y - e))
        self.z, self.u, self.h, self.s, self.e, self.q = (list(part) for part in zip(*views))

    def moments(self) -> dict[str, np.ndarray]:
        """Sums over the rows of what they add to every other row's sums, up to the second power of the rows' products."""
        z, s, e, q, n = self.z, self.s, self.e, self.q, range(len(self.z))
        out = {}
        for a in n:
            for b in n:
                f = q[a] * s[b]
                out[f"q{a},{b}"] = np.array([[q[a] @ q[b]]])
                out[f"one{a},{b}"], out[f"two{a},{b}"] = (f @ z[b])[None], (z[b].T * (f * e[b])) @ z[b]
                out[f"both{a},{b}"] = (z[a].T * (s[a] * s[b])) @ z[b]
            f = self.y * s[a]
            out[f"y{a}"], out[f"yone{a}"], out[f"ytwo{a}"] = np.array([[self.y @ q[a]]]), (f @ z[a])[None], (z[a].T * (f * e[a])) @ z[a]
        return out

    def largest(self) -> list[float]:
        return [float(np.abs(v).max(initial=0.0)) for v in (np.stack(self.h), np.stack(self.e), np.stack(self.q), self.y)]

    def sums(self, m: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per row the products of the other rows' leave-two-out predictions, with each other and with their values."""
        u, h, s, e, q, n = self.u, self.h, self.s, self.e, self.q, range(len(self.z))
        twice = lambda a, b, name: ((u[a] @ m[name]) * u[b]).sum(1)
        own = [h[a] * s[a] * e[a] * (1 + h[a] * s[a]) for a in n]  # what the row itself adds is taken off
        less = lambda a, b: e[b] * (u[b] @ m[f"one{a},{b}"][0]) + s[b] * twice(b, b, f"two{a},{b}") - q[a] * own[b]
        g = np.empty((len(self.y), len(n), len(n)))
        for a in n:
            for b in n:
                g[:, a, b] = (m[f"q{a},{b}"][0, 0] - q[a] * q[b] - less(a, b) - less(b, a)
                              + e[a] * e[b] * (twice(a, b, f"both{a},{b}") - h[a] * h[b] * s[a] * s[b]))
        c = np.stack([m[f"y{a}"][0, 0] - self.y * q[a] - e[a] * (u[a] @ m[f"yone{a}"][0]) - s[a] * twice(a, a, f"ytwo{a}") + self.y * own[a] for a in n], axis=1)
        return g, c


def beyond_moments(h: float, e: float, q: float, y: float) -> float:
    """Upper bound of what powers above the second add to a sum, from the largest leverage, residual, prediction and value.

    Products of two rows are at most `h`, and the squares of one row's products sum up to at most `h`."""
    if not h < 0.5:
        return np.inf
    s = 1 / (1 - h)
    rest = h * s ** 3 * e * (1 + h * s) / (1 - (h * s) ** 2)  # of one prediction, for each square of the product
    most = max(q + h * s * e + (h * s) ** 2 * e, y)
    return h * (2 * most * rest + (h * rest) ** 2) + 2 * h ** 2 * s ** 3 * e ** 2 + h ** 3 * s ** 4 * e ** 2


def leave_two_out_moments(d: DataFrame, vecs: Sequence[str], fits: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray] | None:
    """Moments that stand for the pairs of all rows; None where higher powers might show, or an item has several rows."""
    sizes = [len(fits[v][0]) for v in vecs]
    if 3 * sum(sizes) ** 2 > MOMENTS:
        return None

    def partial(batches):
        acc, top = None, [0.0] * 4
        for pdf in batches:
            if len(pdf):
                rows = LeftOut(pdf, vecs, fits)
                more = rows.moments()
                acc = more if acc is None else {k: v + more[k] for k, v in acc.items()}
                top = [max(a, b) for a, b in zip(top, rows.largest())]
        if acc is not None:
            found = [(k, i, row) for k, v in acc.items() for i, row in enumerate(v)]
            yield pd.DataFrame([("largest", 0, top), *found], columns=["name", "row", "vals"])

    parts = d.select("_y", *vecs).mapInPandas(partial, "name string, row int, vals array<double>")
    vals = array_to_vector("vals")
    rows = parts.groupBy("name", "row").agg(vector_to_array(Summarizer.sum(vals)).alias("total"), vector_to_array(Summarizer.max(vals)).alias("most")).orderBy("name", "row").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["name"], []).append(r["most"] if r["name"] == "largest" else r["total"])
    if not out:
        return None
    bound = beyond_moments(*out.pop("largest")[0])
    moments = {k: np.array(v) for k, v in out.items()}
    if not bound <= SLACK * min(moments[f"q{a},{a}"][0, 0] for a in range(len(vecs))):
        return None
    _, most = group_load(d, ["_id"])
    return moments if most == 1 else None


def nested_ensemble(df: DataFrame, vecs: Sequence[str], target: str, item: str | Sequence[str] = "item", alpha: float = 1.0,
                    tile: int = 2048) -> DataFrame:
    """Leak-free ensemble of ridge models. For each item i the combination weights are fitted
    on the predictions of every other item j by models that saw neither i nor j.

    Those leave-two-out predictions follow in closed form; chunk x chunk tiles reduce them to the
    few sums each item needs, so the item x item matrix is never stored. With many items two rows' products are so small
    that powers above the second add less to a sum than SLACK of it, by a bound from the largest leverage; the sums then
    follow from moments of the rows, without meeting pairs. `item` names the columns that
    identify an item, such as category and code where codes repeat.
    """
    vecs, names = list(vecs), [item] if isinstance(item, str) else list(item)
    fits = {}
    for v in vecs:
        zz, zy, _ = cross_products(df, v, target)
        inv = np.linalg.inv(zz + _penalty(len(zz), alpha))
        fits[v] = (inv, inv @ zy)
    k = len(vecs)
    d = df.select(F.lit(0).alias("_all"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("_id"), *names, F.col(target).cast("double").alias("_y"),
                  *[F.col(v).cast("array<double>").alias(v) for v in vecs]).dropna(subset=["_y", *vecs])
    kinds = ", ".join(f"`{n}` {d.schema[n].dataType.simpleString()}" for n in names)
    result = f"{kinds}, true_score double, weights array<double>, predicted_score double"
    if (moments := leave_two_out_moments(d, vecs, fits)) is not None:
        def from_moments(batches):
            for pdf in batches:
                if len(pdf):
                    rows = LeftOut(pdf, vecs, fits)
                    w = nnls_weights(*rows.sums(moments))
                    yield pd.DataFrame({**{n: pdf[n] for n in names}, "true_score": pdf["_y"], "weights": list(w), "predicted_score": (w * np.stack(rows.q, axis=1)).sum(axis=1)})

        return d.drop("_id", "_all").mapInPandas(from_moments, result)
    _, largest = group_load(d, ["_all"])
    left, right = _tiled(d.drop(*names), ["_all"], "_id", band_rows(largest, tile), largest)

    def parts(pdf: pd.DataFrame, v: str):
        inv, coef = fits[v]
        z = np.column_stack([np.stack(pdf[v].to_numpy()), np.ones(len(pdf))])
        y = pdf["_y"].to_numpy()
        return z, y - z @ coef, np.einsum("ij,jk,ik->i", z, inv, z)

    def block_sums(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        yj = b["_y"].to_numpy()
        other = a["_id"].to_numpy()[:, None] != b["_id"].to_numpy()[None, :]
        preds = []
        for v in vecs:
            (zi, ei, hi), (zj, ej, hj) = parts(a, v), parts(b, v)
            hij = zi @ fits[v][0] @ zj.T
            det = (1 - hi)[:, None] * (1 - hj)[None, :] - hij ** 2
            res = ((1 - hi)[:, None] * ej[None, :] + hij * ei[:, None]) / np.where(other, det, 1.0)
            preds.append(np.where(other, yj[None, :] - res, 0.0))
        p = np.stack(preds)
        return np.einsum("anm,bnm->nab", p, p).reshape(len(a), -1), np.einsum("anm,m->na", p, yj)

    def tile_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("_id", "g", "c")})
        g, own = np.zeros((len(a), k * k)), np.zeros((len(a), k))
        for i in range(0, len(a), tile):
            for j in range(0, len(b), tile):
                more, rest = block_sums(a[i:i + tile], b[j:j + tile])
                g[i:i + tile] += more
                own[i:i + tile] += rest
        return pd.DataFrame({"_id": a["_id"].to_numpy(), "g": list(g), "c": list(own)})

    a, b = (x.toDF(*x.columns) for x in (left, right))
    on = ["_all", "_ca", "_cb"]
    sums = a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(tile_sums, "_id string, g array<double>, c array<double>")
    add = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)
    sums = sums.groupBy("_id").agg(add("g"), add("c"))

    def combine(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            outer = np.zeros((len(pdf), k))
            for n, v in enumerate(vecs):
                z, e, h = parts(pdf, v)
                outer[:, n] = pdf["_y"].to_numpy() - e / (1 - h)
            w = nnls_weights(np.stack(pdf["g"].to_numpy()).reshape(-1, k, k), np.stack(pdf["c"].to_numpy()))
            yield pd.DataFrame({**{n: pdf[n] for n in names}, "true_score": pdf["_y"], "weights": list(w), "predicted_score": (w * outer).sum(axis=1)})

    return d.join(sums, ["_id"]).mapInPandas(combine, result)


def mean_ensemble(oof: DataFrame, models: Sequence[str]) -> DataFrame:
    """Equal-weight mean over items known to every model."""
    total = sum((F.col(m) for m in models[1:]), F.col(models[0]))
    return align_models(oof, models).select("category", "item", "true_score", (total / F.lit(float(len(models)))).alias("predicted_score"))


def rank_ensemble(oof: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean of within-category rank percentiles."""
    d = align_models(oof, models)
    for m in models:
        d = add_rank_pct(d, ["category"], m, f"_r_{m}")
    total = sum((F.col(f"_r_{m}") for m in models[1:]), F.col(f"_r_{models[0]}"))
    return d.select("category", "item", "true_score", (total / F.lit(float(len(models)))).alias("predicted_score"))


def pairwise_logistic(items: DataFrame, vec: str, keys: Sequence[str] = ("category",), c: float = 1.0,
                      weight: str = "none", deviation: str = "std", count: str = "n") -> np.ndarray:
    """Coefficients of the logistic model of item differences, no intercept, L2 strength 1/C.

    `weight` is a scheme of `pairs.pair_weight`; `deviation` and `count` name the columns it reads. Pairs are
    compared inside tasks and never become rows (see `pairwise_fit`)."""
    found = pairwise_fit.fit(items, vec, None, keys, c, weight, deviation, count)
    return found[""][0] if found else np.zeros(0)


def hierarchical_logistic(items: DataFrame, vec: str, subset: str, keys: Sequence[str] = ("category",), c: float = 1.0,
                          strength: float | None = None, weight: str = "none", deviation: str = "std", count: str = "n") -> dict[str, np.ndarray]:
    """D5 per subset, shrunk to their mean by strength / (strength + pairs); both directions of a pair count.

    Subsets are weighted by their pairs, whatever the weights of single pairs. All subsets are fitted in the same
    passes. Subsets without pairs take the mean; so does key None. Without any pair all coefficients are zero."""
    found = pairwise_fit.fit(items, vec, subset, keys, c, weight, deviation, count)
    fits = {s: (coef, pairs) for s, (coef, pairs) in found.items() if pairs}
    if not fits:
        return {**{s: coef for s, (coef, _) in found.items()}, None: next((coef for coef, _ in found.values()), np.zeros(0))}
    total = sum(pairs for _, pairs in fits.values())
    mean = sum(coef * (pairs / total) for coef, pairs in fits.values())
    a = float(np.median([pairs for _, pairs in fits.values()])) if strength is None else strength
    return {**{s: mean for s in found}, **{s: (pairs * coef + a * mean) / (a + pairs) for s, (coef, pairs) in fits.items()}, None: mean}


def with_fold(df: DataFrame, item: str | Sequence[str], folds: int, seed: int) -> DataFrame:
    """Fold number of an item by hash; `item` is a column, or the columns that identify an item."""
    names = [item] if isinstance(item, str) else item
    return df.withColumn("fold", F.pmod(hash32(seed, "fold", *[F.col(n) for n in names]), F.lit(folds)).cast("int"))


def boosted_trees_oof(df: DataFrame, vec: str, target: str, item: str | Sequence[str], folds: int = 5, seed: int = 42, rounds: int = 100,
                      max_leaves_depth: int = 5, early_stop: bool = False) -> DataFrame:
    """Out-of-fold scores of gradient-boosted trees; one fit per fold of a fixed small number.

    `early_stop` holds a tenth of the training rows out and stops when they no longer improve."""
    d = with_fold(df, item, folds, seed).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    d = d.withColumn("_held", uniform(seed, "held", *[F.col(n) for n in ([item] if isinstance(item, str) else item)]) < 0.1)
    out = None
    for f in range(folds):
        gbt = GBTRegressor(featuresCol="_v", labelCol=target, predictionCol="predicted_score", maxIter=rounds,
                           maxDepth=max_leaves_depth, seed=seed, **({"validationIndicatorCol": "_held"} if early_stop else {}))
        part = gbt.fit(d.filter(F.col("fold") != f)).transform(d.filter(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out.drop("_v", "_held")


def partial_least_squares(df: DataFrame, vec: str, target: str, k: int = 20, out: str = "pls") -> DataFrame:
    """Scores on up to k PLS directions of the standardised block, found from cross products."""
    zz, zy, yy = cross_products(df, vec, target)
    n = zz[-1, -1]
    mean, ybar = zz[:-1, -1] / n, zy[-1] / n
    cov = zz[:-1, :-1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov) / (n - 1))
    sd = np.where(sd > 0, sd, 1.0)
    s, r = cov / np.outer(sd, sd), (zy[:-1] - n * mean * ybar) / sd
    ws, ps = [], []
    for _ in range(min(k, len(r), int(n) - 1)):
        size = np.linalg.norm(r)
        if size < 1e-10 * max(1.0, np.sqrt(max(yy, 0.0))):
            break
        w = r / size
        tt = w @ s @ w
        p = s @ w / tt
        q = r @ w / tt
        s, r = s - tt * np.outer(p, p), r - q * tt * p
        ws.append(w)
        ps.append(p)
    w, p = np.array(ws).T, np.array(ps).T
    rot = (w @ np.linalg.inv(p.T @ w)) / sd[:, None]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<double>"

    def project(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**{out: list((np.stack(pdf[vec].to_numpy()).astype(float) - mean) @ rot)})

    return df.dropna(subset=[vec]).mapInPandas(project, schema)


def linear_probe(train: DataFrame, vec: str, label: str, c: float = 1.0):
    """Multinomial logistic model on a frozen vector, L2 strength 1/C."""
    d = train.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / (c * d.count()), maxIter=500, tol=1e-9).fit(d)


def random_baseline(items: DataFrame, seeds: int) -> DataFrame:
    """Pairwise accuracy of hashed random scores, one row per seed."""
    d = spread(items.select("category", "item", "true_score"), "category", "item").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    d = d.withColumn("predicted_score", uniform("baseline", F.col("seed"), F.col("category"), F.col("item")))
    total, largest = group_load(items, ["category"])
    acc = pairwise_accuracy(d, ["seed", "category"], load=(total * seeds, largest))
    return acc.groupBy("seed").agg(ratio(F.sum("correct"), F.sum("pairs")).alias("pairwise_accuracy"))


def sweep_rank(board: DataFrame, model: str, by: Sequence[str], metric: str) -> DataFrame:
    """Place of one model in every setting of a sweep (few models per setting)."""
    own = board.filter(F.col("model") == model).select(*by, F.col(metric).alias("_own"))
    above = F.sum(F.when(F.col(metric) > F.col("_own"), 1).otherwise(0)) + 1
    return board.join(F.broadcast(own), list(by)).groupBy(*by).agg(above.alias("rank"))


def ablation_grid(oof: DataFrame, models: Sequence[str], least_rows: int = 210) -> DataFrame:
    """Pairwise accuracy by feature subset (rows) and model (columns); thin files are rejected."""
    n = oof.groupBy("model", "subset").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_rows)
    acc = pairwise_accuracy(oof, ["model", "subset", "category"]).join(F.broadcast(n), ["model", "subset"], "left_semi")
    d = acc.groupBy("model", "subset").agg(ratio(F.sum("correct"), F.sum("pairs")).alias("accuracy"))
    return d.groupBy("subset").pivot("model", list(models)).agg(F.first("accuracy"))
