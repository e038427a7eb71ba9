"""Vector pooling, imputation, scaling and projection of item feature blocks.

A block is an ARRAY<DOUBLE> column, NULL when an item lacks it. `long_blocks` turns wide blocks
into rows (block, vec), so that every block is processed by the same plan at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from prefrank.operators.conform import quantiles
from prefrank.operators.pairs import TILE, _tiled, band_rows
from prefrank.operators.skew import broadcast_if_small, group_load, join_keys


#: Numbers a task holds of the vectors it pools before it passes them on.
HELD = 1 << 22


def pooled(df: DataFrame, keys: Sequence[str], vec: str, how: str = "mean", weight: str | None = None,
           out: str = "vec") -> DataFrame:
    """Element-wise mean (weighted), max or sum of the vectors of a group; merged map-side."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if how == "max":
        agg = vector_to_array(Summarizer.max(v))
    elif how == "sum":
        agg = vector_to_array(Summarizer.sum(v, w))
    else:
        agg = vector_to_array(Summarizer.mean(v, w))
    return df.filter(F.col(vec).isNotNull()).groupBy(*keys).agg(agg.alias(out))


def pooled_in_tasks(df: DataFrame, key: str, vec: str, how: str = "mean", weight: str | None = None) -> DataFrame:
    """`pooled` by one key: tasks pool the rows they read, batch by batch, and only the pools are shuffled.

    An aggregation of vectors by more than a few keys sorts its rows, and vectors of many rows then spill. Vectors
    have one length and no unknown entries.
    """
    most = how == "max"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pools, weights = {}, np.zeros((0, 0)), np.zeros(0)

        def found() -> pa.RecordBatch:
            n, long = len(place), pools.shape[1]
            ends = np.arange(n + 1, dtype="i4") * long
            return pa.RecordBatch.from_arrays([pa.array(list(place), kind), pa.ListArray.from_arrays(pa.array(ends), pa.array(pools[:n].ravel())), pa.array(weights[:n])], names=[key, "_pool", "_w"])

        for b in batches:
            if not len(b):
                continue
            kind, flat = b.column(key).type, b.column("_v").flatten()
            long = len(flat) // len(b)
            if flat.null_count or (np.diff(b.column("_v").offsets.to_numpy()) != long).any() or (place and long != pools.shape[1]):
                raise ValueError("vectors to pool differ in length or have unknown entries")
            names = b.column(key).dictionary_encode(null_encoding="encode")
            codes, w = names.indices.to_numpy(), b.column("_w").to_numpy()
            order = np.argsort(codes, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
            v = flat.to_numpy().reshape(-1, long).astype(float)[order]
            some = np.fmax.reduceat(v, heads) if most else np.add.reduceat(v * w[order][:, None], heads)
            listed = names.dictionary.to_pylist()
            at = np.array([place.setdefault(listed[c], len(place)) for c in codes[order][heads]])
            if len(place) > len(pools):
                more = max(2 * len(pools), len(place)) - len(pools)
                pools = np.vstack([pools.reshape(-1, long), np.full((more, long), -np.inf if most else 0.0)])
                weights = np.append(weights, np.zeros(more))
            pools[at] = np.fmax(pools[at], some) if most else pools[at] + some
            weights[at] += np.add.reduceat(w[order], heads)
            if len(place) * long > HELD:
                yield found()
                place, pools, weights = {}, np.zeros((0, 0)), np.zeros(0)
        if place:
            yield found()

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.filter(F.col(vec).isNotNull()).select(key, F.col(vec).alias("_v"), w.alias("_w"))
    d = d.mapInArrow(partial, f"`{key}` {df.schema[key].dataType.simpleString()}, _pool array<double>, _w double")
    v = array_to_vector("_pool")
    d = d.groupBy(key).agg(vector_to_array(Summarizer.max(v) if most else Summarizer.sum(v)).alias("vec"), F.sum("_w").alias("_w"))
    return d.select(key, (F.transform("vec", lambda x: x / F.col("_w")) if how == "mean" else F.col("vec")).alias(vec))


def long_blocks(df: DataFrame, blocks: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per item and present block: (keep..., block, vec)."""
    pairs = F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("array<double>").alias("vec")) for b in blocks])
    return df.select(*keep, F.explode(pairs).alias("_b")).select(*keep, "_b.block", "_b.vec").filter("vec IS NOT NULL")


def complete_rows(df: DataFrame, blocks: Sequence[str], out: str = "vec") -> DataFrame:
    """Blocks joined end to end; items missing one are dropped."""
    return df.dropna(subset=list(blocks)).withColumn(out, F.concat(*[F.col(b).cast("array<double>") for b in blocks]))


def _as_array(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("pos", *cols)))
    d = df.groupBy(*keys).agg(packed.alias("_p"))
    return d.select(*keys, *[F.col(f"_p.{c}").alias(f"_{c}") for c in cols])


def column_means(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    d = df.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return _as_array(d, keys, ["m"])


def impute_column_means(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Unknown entries take the mean of their position over the whole key (one row per key)."""
    m = column_means(df, keys, vec)
    d = join_keys(df, broadcast_if_small(m), list(keys)) if keys else df.crossJoin(F.broadcast(m))  # one row
    return d.withColumn(vec, F.zip_with(vec, "_m", lambda x, y: F.coalesce(x, y))).drop("_m")


def scaled(df: DataFrame, keys: Sequence[str], vec: str, scaler: str = "standard") -> DataFrame:
    """P5: per position, (x - shift) / scale with a zero scale read as one.

    standard: mean and population deviation; minmax: minimum and range; robust: median and
    interquartile range. The statistics hold one row per key (a block); they are broadcast if counted small.
    """
    if scaler == "none":
        return df
    keys = list(keys)
    d = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    if scaler == "robust":
        q = quantiles(d, [*keys, "pos"], "x", [.25, .5, .75])
        s = q.select(*keys, "pos", F.col("q")[1].alias("shift"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    else:
        shift, scale = {"standard": (F.avg("x"), F.stddev_pop("x")),
                        "minmax": (F.min("x"), F.max("x") - F.min("x"))}[scaler]
        s = d.groupBy(*keys, "pos").agg(shift.alias("shift"), scale.alias("scale"))
    s = s.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    s = _as_array(s, keys, ["shift", "scale"])
    d = join_keys(df, broadcast_if_small(s), keys) if keys else df.crossJoin(F.broadcast(s))  # one row
    moved = F.zip_with(vec, "_shift", lambda x, y: x - y)
    return d.withColumn(vec, F.zip_with(moved, "_scale", lambda x, y: x / y)).drop("_shift", "_scale")


def nearest_neighbours(queries: DataFrame, refs: DataFrame, key: str, item: str, vec: str, k: int, group: str | None = None) -> DataFrame:
    """The k nearest references of the same key by cosine distance, (distance, item) order.

    `group` is a second part of an item's identity, for codes that repeat; it comes back as `group` and
    `neighbour_group`.
    Distances are computed chunk against chunk; only the k best of each chunk leave a task.
    """
    ids = [item] if group is None else [item, group]
    near = ["neighbour"] if group is None else ["neighbour", "neighbour_group"]
    q = queries.select(key, *ids, F.col(vec).alias("_v"), F.lit(True).alias("_left"))
    r = refs.select(key, *ids, F.col(vec).alias("_v"), F.lit(False).alias("_left"))
    both = q.unionByName(r)
    _, largest = group_load(both, [key])
    left, right = _tiled(both, [key], item, band_rows(largest), largest)
    on = [key, "_ca", "_cb"]

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [key, *ids, *near, "distance"]})
        b = b.sort_values(ids)
        va, vb = (np.stack(d["_v"].to_numpy()).astype(float) for d in (a, b))
        na, nb = (np.linalg.norm(v, axis=1) for v in (va, vb))
        na, nb = np.where(na == 0, 1, na), np.where(nb == 0, 1, nb)
        best, places = [], []
        for i in range(0, len(a), TILE):
            dist, at = np.zeros((len(va[i:i + TILE]), 0)), np.zeros((len(va[i:i + TILE]), 0), int)
            for j in range(0, len(b), TILE):  # the k best so far come first, so that equal distances keep the order of items
                block = 1 - (va[i:i + TILE] @ vb[j:j + TILE].T) / na[i:i + TILE, None] / nb[None, j:j + TILE]
                dist, at = np.hstack([dist, block]), np.hstack([at, np.broadcast_to(np.arange(j, j + block.shape[1]), block.shape)])
                order = np.argsort(dist, axis=1, kind="stable")[:, :k]
                dist, at = np.take_along_axis(dist, order, 1), np.take_along_axis(at, order, 1)
            best.append(dist)
            places.append(at)
        dist, top = np.vstack(best), np.vstack(places)
        n = top.shape[1]
        return pd.DataFrame({**{c: np.repeat(a[c].to_numpy(), n) for c in [key, *ids]}, **{o: b[c].to_numpy()[top].ravel() for o, c in zip(near, ids)},
                             "distance": dist.ravel()})

    kinds = [(c, both.schema[s].dataType.simpleString()) for c, s in zip([key, *ids, *near], [key, *ids, *ids])]
    a, b = (d.toDF(*d.columns) for d in (left.filter("_left"), right.filter("NOT _left")))
    best = a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(
        tile, ", ".join(f"`{c}` {t}" for c, t in kinds) + ", distance double")
    w = W.partitionBy(key, *ids).orderBy("distance", *near)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_imputed(df: DataFrame, blocks: Sequence[str], k: int = 5, only: Sequence[str] | None = None) -> DataFrame:
    """A missing block becomes the mean of that block over the k nearest complete items of the
    category, by cosine on the blocks the item has; over all complete items if the category has none.
    Items are known by category and code, so codes may repeat. Items without any block are dropped."""
    blocks = list(blocks)
    present = F.concat(*[F.when(F.col(b).isNotNull(), F.lit("1")).otherwise(F.lit("0")) for b in blocks])
    d = df.withColumn("_have", present).filter(F.col("_have").contains("1"))
    full = "1" * len(blocks)
    complete = d.filter(F.col("_have") == full)
    gaps = d.filter(F.col("_have") != full)
    homes = complete.select("category").distinct().withColumn("_home", F.lit(True))
    gaps = join_keys(gaps, broadcast_if_small(homes), ["category"], "left")
    patterns = [r["_have"] for r in gaps.select("_have").distinct().collect()]  # at most 2^blocks values
    out = complete.drop("_have")
    for pattern in patterns:
        have = [b for b, bit in zip(blocks, pattern) if bit == "1"]
        lack = [b for b in blocks if b not in have and (only is None or b in only)]
        route = lambda own: F.coalesce(F.concat(F.lit("c:"), F.col("category").cast("string")), F.lit("n:")) if own else F.lit("*")
        joined = F.concat(*[F.col(b) for b in have]).alias("_q")
        some = gaps.filter(F.col("_have") == pattern)
        q = some.select(F.when(F.col("_home"), route(True)).otherwise(route(False)).alias("_route"), "category", "item", joined)
        orphans = q.filter("_route = '*'").select("_route").distinct()
        refs = complete.select(route(True).alias("_route"), "category", "item", joined).unionByName(
            complete.select(route(False).alias("_route"), "category", "item", joined).join(F.broadcast(orphans), ["_route"], "left_semi"))
        near = nearest_neighbours(q, refs, "_route", "item", "_q", k, "category")
        filled = join_keys(near, complete.select(F.col("item").alias("neighbour"), F.col("category").alias("neighbour_group"), *lack), ["neighbour", "neighbour_group"])
        fixed = some.drop("_have", "_home", *lack)
        for b in lack:
            fixed = join_keys(fixed, pooled(filled, ["category", "item"], b, "mean", out=b), ["category", "item"])
        out = out.unionByName(fixed.select(*out.columns))
    return out


def projected(df: DataFrame, vec: str, variance: float | None = 0.95, k: int | None = None,
              out: str = "pc") -> DataFrame:
    """Centred principal components: a fixed k, or as many as explain the asked variance."""
    d = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    dims = len(d.select(vec).first()[0])
    mean = F.broadcast(pooled(df, [], vec, "mean", out="_mean"))
    centred = df.crossJoin(mean).withColumn(
        "_v", array_to_vector(F.zip_with(F.col(vec).cast("array<double>"), "_mean", lambda x, y: x - y))).drop("_mean")
    model = PCA(k=dims if k is None else min(k, dims), inputCol="_v", outputCol="_pc").fit(centred)
    keep = k or int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), variance - 1e-12)) + 1
    return model.transform(centred).withColumn(out, F.slice(vector_to_array("_pc"), 1, keep)).drop("_v", "_pc")


def scaled_and_projected(df: DataFrame, blocks: Sequence[str], scaler: str = "standard",
                         variance: float = 0.95, wide: int = 10) -> DataFrame:
    """Scale every block; blocks wider than `wide` are also projected."""
    for b in blocks:
        df = scaled(df, [], b, scaler)
        if len(df.select(b).first()[0]) > wide:
            df = projected(df, b, variance, out="_p").drop(b).withColumnRenamed("_p", b)
    return df


def coverage(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Items, items with every block, and items missing each block."""
    gone = {b: F.col(b).isNull() for b in blocks}
    every = F.lit(True)
    for g in gone.values():
        every = every & ~g
    return df.agg(F.count(F.lit(1)).alias("items"), F.sum(F.when(every, 1).otherwise(0)).alias("complete"),
                  *[F.sum(F.when(g, 1).otherwise(0)).alias(f"missing_{b}") for b, g in gone.items()])


