"""Pairwise logistic models fitted without a table of pairs.

Newton's method on the loss over all ordered pairs of a group. A task holds chunks of items and compares them
block by block; only a square matrix, a gradient and a few sums per model leave it, and those are added up in
parallel. Small groups stand side by side in a task, and all their rows meet the next, the second next and so on
together; a large group is cut into chunks that meet two by two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from prefrank.functions.stats import beta_tail
from prefrank.operators.pairs import TILE, band_rows
from prefrank.operators.skew import broadcast_if_small, group_load
from prefrank.session import cut_lineage

#: Rows of one side compared at once in a task: bounds its matrices.
BLOCK = 1024
#: Rows of small groups compared together, and of the largest group whose rows meet the next ones one by one.
PACK = 64
#: Rows of small groups in a slot, on average: few, so that the tasks' slots even out.
SLOT_ROWS = 5_000
#: A square matrix of this size must fit the driver and a task.
MAX_FEATURES = 4096
SCHEMES = ("none", "score_diff", "t_stat", "p_value")


def slotted(items: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """`items` (with _i and _y) keyed by _slot and _side, so that all pairs of a group meet.

    Slots "s..." hold whole groups, all on side 0. Slots "h..." hold two chunks of a large group, or one
    on side 0 that meets itself. Null keys are groups like any other.
    """
    d = items.withColumn("_g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    total, largest = group_load(d, ["_g"])
    chunk = band_rows(largest, tile)
    slots = max(d.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SLOT_ROWS))
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("_g"), F.lit(slots)))
    if largest <= chunk:
        return d.withColumn("_slot", shared).withColumn("_side", F.lit(0))
    hot = d.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks")).filter("_chunks > 1")
    d = d.join(broadcast_if_small(hot), ["_g"], "left")
    own = F.coalesce(F.pmod(F.xxhash64("_i", "_y"), F.col("_chunks")).cast("int"), F.lit(0))
    d = d.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
    pair = F.concat_ws(":", F.lit("h"), F.least("_own", "_other"), F.greatest("_own", "_other"), F.col("_g"))
    d = d.withColumn("_slot", F.when(F.col("_chunks").isNull(), shared).otherwise(pair))
    return d.withColumn("_side", (F.col("_own") > F.col("_other")).cast("int")).drop("_chunks", "_own", "_other")


class Side:
    """Rows of one side of a comparison as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.x, self.y, self.item, self.group = np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(float), pdf["_i"].to_numpy(), pd.factorize(pdf["_g"])[0]
        self.std, self.n = pdf["_std"].to_numpy(float), pdf["_n"].to_numpy(float)

    def cut(self, start: int, stop: int) -> Side:
        part = object.__new__(Side)
        part.__dict__.update({k: v[start:stop] for k, v in self.__dict__.items()})
        return part

    def pieces(self) -> Iterator[tuple[int, Side]]:
        return ((at, self.cut(at, at + BLOCK)) for at in range(0, len(self.y), BLOCK))


def pair_weights(scheme: str, gap: np.ndarray, a: Side, b: Side) -> np.ndarray:
    """Weight of each pair of the sides by `weights_of`."""
    return weights_of(scheme, gap, a.std[:, None], a.n[:, None], b.std[None, :], b.n[None, :])


def weights_of(scheme: str, gap: np.ndarray, std_a: np.ndarray, n_a: np.ndarray, std_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Weight of each pair by the schemes of `pairs.pair_weight`; 1 where the spread is zero or unknown."""
    if scheme == "none":
        return np.ones_like(gap)
    if scheme == "score_diff":
        return np.abs(gap)
    va, vb = std_a ** 2 / np.fmax(n_a, 1), std_b ** 2 / np.fmax(n_b, 1)
    var = va + vb
    known = var > 0
    t = np.abs(gap) / np.sqrt(np.where(known, var, 1.0))
    if scheme == "t_stat":
        return np.where(known, np.minimum(t, 5.0), 1.0)
    below = va ** 2 / np.fmax(n_a - 1, 1) + vb ** 2 / np.fmax(n_b - 1, 1)
    free = np.where(below > 0, var ** 2 / np.where(below > 0, below, 1.0), 1.0)
    out = np.ones_like(gap)
    f, s = free[known], t[known]
    out[known] = 1 - beta_tail(f / 2, np.full(len(s), 0.5), f / (f + s * s))
    return out


class Sums:
    """Second and first derivatives and the sums of loss, weight and pairs, both directions of a pair counted."""

    def __init__(self, size: int):
        self.hess, self.grad, self.rest = np.zeros((size, size)), np.zeros(size), np.zeros(3)

    def add(self, a: Side, b: Side, coef: np.ndarray, scheme: str, same: bool) -> None:
        """Pairs of `a` and `b`. Where both are the `same` rows, each pair is taken from its better side only."""
        gap = a.y[:, None] - b.y[None, :]
        use = ((gap > 0) if same else (gap != 0)) & (a.item[:, None] != b.item[None, :]) & (a.group[:, None] == b.group[None, :])
        if not use.any():
            return
        weight = 2.0 * np.where(use, pair_weights(scheme, gap, a, b), 0.0)
        sign = np.sign(gap)
        margin = sign * ((a.x @ coef)[:, None] - (b.x @ coef)[None, :])
        lost = np.logaddexp(0.0, -margin)
        miss = np.exp(-np.logaddexp(0.0, margin))  # probability of the wrong order
        slope, curve = -weight * sign * miss, weight * miss * (1 - miss)
        self.grad += slope.sum(1) @ a.x - slope.sum(0) @ b.x
        cross = a.x.T @ curve @ b.x
        self.hess += (a.x.T * curve.sum(1)) @ a.x + (b.x.T * curve.sum(0)) @ b.x - cross - cross.T
        self.rest += (weight * lost).sum(), weight.sum(), 2.0 * use.sum()


    def add_next(self, side: Side, left: np.ndarray, step: int, coef: np.ndarray, scheme: str) -> None:
        """Pairs of the rows `left` and the rows `step` places after them, one by one."""
        gap = side.y[left] - side.y[left + step]
        use = (gap != 0) & (side.item[left] != side.item[left + step])
        left, gap = left[use], gap[use]
        if not len(left):
            return
        right = left + step
        weight = 2.0 * weights_of(scheme, gap, side.std[left], side.n[left], side.std[right], side.n[right])
        better = (side.x[left] - side.x[right]) * np.sign(gap)[:, None]
        margin = better @ coef
        low = np.exp(-np.abs(margin))
        miss = np.where(margin > 0, low, 1.0) / (1 + low)  # probability of the wrong order
        self.grad -= (weight * miss) @ better
        self.hess += (better.T * (weight * miss * (1 - miss))) @ better
        self.rest += (weight * (np.log1p(low) + np.maximum(-margin, 0.0))).sum(), weight.sum(), 2.0 * len(left)


def runs(groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut sorted group numbers into runs of whole groups, of at most PACK rows where a group allows it."""
    starts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
    at = 0
    for one, two in zip(starts[1:], [*starts[2:], None]):
        if two is None or two - at > PACK:
            yield at, int(one)
            at = int(one)


def slot_sums(pdf: pd.DataFrame, coefs: Mapping[str, np.ndarray], scheme: str, out: dict[str, Sums]) -> None:
    """Add the pairs of one slot to the sums of their models."""
    alone = pdf["_slot"].iloc[0].startswith("s") or bool(pdf["_own_chunk"].iloc[0])
    for model, rows in pdf.groupby("_m", sort=True):
        if model not in coefs:
            continue
        coef = coefs[model]
        sums = out.setdefault(model, Sums(len(coef)))
        rows = rows.sort_values(["_side", "_g"], kind="stable")
        left = int((rows["_side"] == 0).sum())
        side = Side(rows)
        a, b = side.cut(0, left), side.cut(left, len(rows))
        if not alone:
            for _, one in a.pieces():
                for _, two in b.pieces():
                    sums.add(one, two, coef, scheme, False)
            continue
        for start, stop in runs(a.group):
            part = list(a.cut(start, stop).pieces())
            for at, one in part:
                for other, two in part:
                    if other >= at:
                        sums.add(one, two, coef, scheme, at == other)


def group_heads(group: pa.Array) -> np.ndarray:
    """Where the groups begin; no group is null."""
    new = pc.not_equal(group.slice(1), group.slice(0, max(0, len(group) - 1)))
    return np.flatnonzero(np.concatenate([[len(group) > 0], new.to_numpy(zero_copy_only=False)]))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by group, cut so that no group is in two batches."""
    held = None
    for b in batches:
        held = b if held is None or not len(held) else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if len(b) else held
        last = int(group_heads(held.column("_g"))[-1]) if len(held) else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and len(held):
        yield held


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups as one row a batch, its groups numbered: steps then read few rows."""
    for b in whole_groups(batches):
        heads = group_heads(b.column("_g"))
        numbers = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(b))))
        b = pa.RecordBatch.from_arrays([pa.array(numbers), *b.columns[1:]], names=b.schema.names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as to:
            to.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_rows"])


def group_sums(batch: pa.RecordBatch, coefs: Mapping[str, np.ndarray], scheme: str, out: dict[str, Sums]) -> None:
    """Add the pairs of whole groups that stand side by side to the sums of their models."""
    heads = group_heads(batch.column("_g"))
    sizes = np.diff(np.append(heads, len(batch)))
    group, place = np.repeat(np.arange(len(heads)), sizes), np.arange(len(batch)) - np.repeat(heads, sizes)
    names = batch.column("_m").dictionary_encode()
    codes, items = names.indices.to_numpy(), batch.column("_i").to_numpy()
    y, std, n = (batch.column(c).cast("float64").to_numpy(zero_copy_only=False) for c in ("_y", "_std", "_n"))
    for code, model in enumerate(names.dictionary.to_pylist()):
        if model not in coefs:
            continue
        coef, rows = coefs[model], np.flatnonzero(codes == code)
        listed = batch.column("_x") if len(rows) == len(batch) else batch.column("_x").take(pa.array(rows))
        if not (pc.list_value_length(listed).to_numpy() == len(coef)).all():
            raise ValueError(f"vectors of model {model!r} differ in length")
        side = object.__new__(Side)
        side.x = listed.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(coef))
        side.y, side.item, side.std, side.n, side.group = y[rows], items[rows], std[rows], n[rows], group[rows]
        sums, rest = out.setdefault(model, Sums(len(coef))), sizes[group[rows]] - place[rows]  # this row and those after it
        small = sizes[group[rows]] <= PACK
        left = np.flatnonzero(small)
        for step in range(1, int(sizes[group[rows]][left].max(initial=0))):
            left = left[rest[left] > step]
            sums.add_next(side, left, step, coef, scheme)
        for g in np.unique(side.group[~small]):
            at = np.flatnonzero(side.group == g)
            part = list(side.cut(at[0], at[-1] + 1).pieces())
            for i, (_, one) in enumerate(part):
                for j in range(i, len(part)):
                    sums.add(one, part[j][1], coef, scheme, i == j)


def by_slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each slot, from batches sorted by slot."""
    held = []
    for pdf in batches:
        for slot, rows in pdf.groupby("_slot", sort=False):
            if held and held[0]["_slot"].iloc[0] != slot:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def all_sums(shared: DataFrame, hot: DataFrame | None, coefs: Mapping[str, np.ndarray], scheme: str) -> dict[str, Sums]:
    """Sums per model over all groups; matrices are added up row by row.

    Each row of `shared` holds whole groups, and each partition of `hot`, the chunks of large ones, whole slots, sorted."""
    def listed(out: dict[str, Sums]) -> list[tuple]:
        return [(m, i, v) for m, s in out.items() for i, v in enumerate([*s.hess, s.grad, s.rest])]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {}
        for one in batches:
            for rows in one.column("_rows"):
                for b in pa.ipc.open_stream(rows.as_buffer()):
                    group_sums(b, coefs, scheme, out)
        found = listed(out)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()),
                                          pa.array([f[2].tolist() for f in found], pa.list_(pa.float64()))], names=["model", "row", "vals"])

    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = {}
        for pdf in by_slot(batches):
            slot_sums(pdf, coefs, scheme, out)
        yield pd.DataFrame(listed(out), columns=["model", "row", "vals"])

    schema = "model string, row int, vals array<double>"
    parts = shared.mapInArrow(small, schema)
    if hot is not None:
        parts = parts.unionByName(hot.mapInPandas(large, schema))
    added = parts.groupBy("model", "row").agg(vector_to_array(Summarizer.sum(array_to_vector("vals"))).alias("vals")).collect()
    out = {m: Sums(len(c)) for m, c in coefs.items()}
    for r in added:
        s, size, vals = out[r["model"]], len(coefs[r["model"]]), np.array(r["vals"])
        if r["row"] < size:
            s.hess[r["row"]] = vals
        elif r["row"] == size:
            s.grad = vals
        else:
            s.rest = vals
    return out


def fit(items: DataFrame, vec: str, model: str | None, keys: Sequence[str] = ("category",), c: float = 1.0, scheme: str = "none",
        deviation: str = "std", count: str = "n", tile: int = TILE, most: int = 100) -> dict[str, tuple[np.ndarray, float]]:
    """Per value of the column `model` (None: one model named ""): coefficients and pairs, both directions counted.

    Minimises the weighted log loss of all pairs of a group with different true_score, plus |w|^2 / 2c. `items`
    has item, true_score and the vector; rows with a null among them, or a null model, are left out, and rows of
    the same item (by a 64-bit hash) are no pair. A model without pairs has zero coefficients. All models are
    fitted in the same passes; a model's step is halved while it does not lower its loss.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown weighting {scheme!r}; one of {SCHEMES}")
    spread = [F.col(deviation), F.col(count)] if scheme in ("t_stat", "p_value") else [F.lit(None), F.lit(None)]
    name = F.lit("") if model is None else F.col(model).cast("string")
    d = items.where(F.col("item").isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name.alias("_m"), F.xxhash64("item").alias("_i"), F.col("true_score").cast("double").alias("_y"),
                                                      F.col(vec).cast("array<double>").alias("_x"), spread[0].cast("double").alias("_std"), spread[1].cast("double").alias("_n"))
    found = cut_lineage(d.dropna(subset=["_m", "_y", "_x"]))  # counted and dealt out
    d = slotted(found, ["_m", *[f"_k{i}" for i in range(len(keys))]], tile).drop(*[f"_k{i}" for i in range(len(keys))])
    halves = F.split("_slot", ":", 4)
    d = d.withColumn("_own_chunk", F.coalesce(F.try_element_at(halves, F.lit(2)) == F.try_element_at(halves, F.lit(3)), F.lit(False)))
    tasks = max(d.sparkSession.sparkContext.defaultParallelism, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = d.repartition(tasks, "_slot").sortWithinPartitions("_slot", "_g")  # the only shuffle: every step reads these partitions
    own = F.col("_slot").startswith("s")
    hot = None
    if not d.filter(~own).isEmpty():
        rows = cut_lineage(rows)
        hot = rows.filter(~own)
    shared = cut_lineage(rows.filter(own).select("_g", "_m", "_i", "_y", "_x", "_std", "_n").mapInArrow(packed, "_rows binary"))
    sizes = {r["_m"]: r["size"] for r in found.groupBy("_m").agg(F.max(F.size("_x")).alias("size")).collect()}
    widest = max(sizes.values(), default=0)
    if widest > MAX_FEATURES:
        raise ValueError(f"{widest} features, at most {MAX_FEATURES}; reduce them first (see features.projected)")
    coefs = {m: np.zeros(n) for m, n in sizes.items()}
    now, scale, open_ = all_sums(shared, hot, coefs, scheme) if coefs else {}, dict.fromkeys(coefs, 1.0), set(coefs)
    pairs = {m: float(np.rint(s.rest[2])) for m, s in now.items()}
    for _ in range(most):
        steps = {}
        for m in sorted(open_):
            slope = now[m].grad + coefs[m] / c
            if np.abs(slope).max(initial=0.0) <= 1e-10 * max(1.0, now[m].rest[1]):
                open_.discard(m)
            else:
                steps[m] = np.linalg.solve(now[m].hess + np.eye(len(slope)) / c, slope) * scale[m]
        if not steps:
            return {m: (coefs[m], pairs[m]) for m in coefs}
        trial = {m: coefs[m] - s for m, s in steps.items()}
        for m, s in all_sums(shared, hot, trial, scheme).items():
            before, after = (v.rest[0] + w @ w / (2 * c) for v, w in ((now[m], coefs[m]), (s, trial[m])))
            if after <= before * (1 + 1e-11):
                coefs[m], now[m], scale[m] = trial[m], s, 1.0
            elif scale[m] < 1e-9:  # no lower value within rounding
                open_.discard(m)
            else:
                scale[m] /= 2
    raise ArithmeticError(f"no minimum after {most} Newton steps")
