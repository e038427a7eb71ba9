"""Resamples as matrices of multiplicities, made where the rows are.

A stratum's rows travel once for a batch of replicates, not once for each. The task hashes the draws of the
batch into a matrix (replicates x units), the same draws as `resample.bootstrap_weights`, and evaluates the
statistic for all replicates together: credits of pairs by one matrix product, or in large groups by one
merge pass over all columns; class scores by products with indicator columns; medians along cumulated weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from prefrank.operators.concordance import near_partners
from prefrank.session import cut_lineage, group_rows

try:
    from _md5 import md5  # the plain build is twice as quick on short keys
except ImportError:
    from hashlib import md5

#: Multiplicities held at once.
CELLS = 1 << 22
#: Largest group whose credits are held as a square matrix.
SQUARE = 2048
#: Rows of one block of the scores with many values, most values of the other scores, and cells of blocks held at once.
STRIP, CLASSES, HELD = 128, 512, 1 << 26
#: Slots hashed at once, and the fewest for which that beats one digest after the other.
BLOCK, FEW = 1 << 16, 2048
#: Slots of several pairs of replicates hashed at once.
LANES = 1 << 16
#: Draws a task should have, and the most tasks made for it.
SHARE, MOST = 10 ** 7, 2000
#: Constants of MD5 (RFC 1321): start, sines, turns of each round.
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def name_words(names: np.ndarray, skip: int) -> np.ndarray:
    """Message words (words x names) of names of equal length (names x bytes) after `skip` bytes of the head's last word."""
    n, long = names.shape
    text = np.zeros((n, (skip + long) // 4 * 4 + 4), dtype="u1")
    text[:, skip:skip + long] = names
    text[:, skip + long] = 0x80  # ends the message
    return np.ascontiguousarray(text.view("<u4").T)


def slot_words(lo: int, hi: int, skip: int) -> np.ndarray:
    """`name_words` of the slots lo to hi, whose names are equally long."""
    names = np.empty((hi - lo, len(str(lo))), dtype="u1")
    rest = np.arange(lo, hi)
    for at in range(names.shape[1] - 1, -1, -1):
        names[:, at] = rest % 10 + 48
        rest = rest // 10
    return name_words(names, skip)


class Names:
    """Names that are hashed after many heads, those of equal length together."""

    def __init__(self, names: Sequence):
        self.names = [str(v).encode() for v in names]
        sizes, self.blocks, self.words = np.array([len(v) for v in self.names], int), [], {}
        for long in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == long)
            for at in range(0, len(rows), BLOCK):
                self.blocks.append((rows[at:at + BLOCK], long))

    def hashes(self, heads: Sequence[bytes]) -> np.ndarray:
        """hash32 of each head and each name (heads x names); with few names, many heads are taken together."""
        out = np.empty((len(heads), len(self.names)), "u8")
        for b, (rows, long) in enumerate(self.blocks):
            if (b, -1) not in self.words:
                self.words[b, -1] = np.frombuffer(b"".join([self.names[i] for i in rows]), "u1").reshape(len(rows), long)
            text = self.words[b, -1]
            for size in {len(h) for h in heads}:
                at = np.flatnonzero([len(h) == size for h in heads])
                if not 0 < long <= 55 - size:
                    for i in at:
                        out[i, rows] = np.frombuffer(b"".join([md5(heads[i] + self.names[r]).digest()[:4] for r in rows]), ">u4")
                elif len(rows) >= FEW:
                    skip = size % 4
                    if (b, skip) not in self.words:
                        self.words[b, skip] = name_words(text, skip)
                    for i in at:
                        out[i, rows] = digests([heads[i]], long, self.words[b, skip])[0][0] >> np.uint64(32)
                else:
                    per = BLOCK // len(rows)
                    for some in (at[k:k + per] for k in range(0, len(at), per)):
                        lead = np.frombuffer(b"".join([heads[i] for i in some]), "u1").reshape(-1, size)
                        both = np.hstack([np.repeat(lead, len(rows), 0), np.tile(text, (len(some), 1))])
                        out[np.ix_(some, rows)] = (digests([b""], size + long, name_words(both, 0))[0][0] >> np.uint64(32)).reshape(len(some), -1)
        return out


def digests(heads: Sequence[bytes], long: int, varying: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of MD5 of each head and each name, as numbers (heads x names); one block of message.

    Heads are equally long; names have `long` bytes and are given as `slot_words`. Steps before the first word of a name
    are taken once a head, and the sums of numbers are taken before they meet a row of names.
    """
    size = len(heads[0])
    first, n = size // 4, varying.shape[1]
    shape = (len(heads), n)
    text = np.zeros((len(heads), 64), "u1")
    text[:, :size] = np.frombuffer(b"".join(heads), "u1").reshape(len(heads), size)
    words = list(np.ascontiguousarray(text.view("<u4").T)[:, :, None])
    words[first] = words[first] | varying[0]
    for i in range(1, len(varying)):
        words[first + i] = np.broadcast_to(varying[i], shape)
    words[14] = np.full((len(heads), 1), 8 * (size + long), "u4")
    a, b, c, d = (np.full((len(heads), 1), v, "u4") for v in START)
    # f and g take what a step makes; a state's room is free again when four more were made
    f, g, h, room = np.empty(shape, "u4"), np.empty(shape, "u4"), np.empty(shape, "u4"), [np.empty(shape, "u4") for _ in range(5)]
    xor = None
    for i in range(64):
        wide = i >= first
        if i < 16:
            k = i
            e = np.bitwise_xor(c, d, out=f) if c.shape == shape or d.shape == shape else c ^ d
            e = np.bitwise_and(e, b, out=f) if b.shape == shape or e.shape == shape else e & b
            e = np.bitwise_xor(e, d, out=f) if e.shape == shape or d.shape == shape else e ^ d
        elif i < 32:
            k = (5 * i + 1) % 16
            e = np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:  # the exclusive or of two states serves two steps
            k = (3 * i + 5) % 16
            if i % 2 == 0:
                xor = np.bitwise_xor(b, c, out=h)
                e = np.bitwise_xor(xor, d, out=f)
            else:
                e = np.bitwise_xor(xor, b, out=f)
        else:
            k = 7 * i % 16
            e = np.invert(d, out=f)
            np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[k]
        if word.shape == shape:
            e = np.add(e, a + np.uint32(SINES[i]) if a.shape != shape else a, out=f)
            e = np.add(f, word, out=f)
            if a.shape == shape:
                np.add(f, np.uint32(SINES[i]), out=f)
        elif a.shape != shape:
            e = np.add(e, a + (word + np.uint32(SINES[i])), out=f) if e.shape == shape else e + (a + (word + np.uint32(SINES[i])))
        else:
            np.add(f, a, out=f)
            # one head: a plain number is quicker than a column
            np.add(f, (word + np.uint32(SINES[i])) if len(heads) > 1 else np.uint32((int(word[0, 0]) + SINES[i]) & 0xFFFFFFFF), out=f)
        turn = TURNS[i // 16][i % 4]
        if wide:
            to = room[i % 5]
            np.left_shift(e, np.uint32(turn), out=g), np.right_shift(e, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
            np.add(f, b, out=to)
        else:
            to = (e << np.uint32(turn) | e >> np.uint32(32 - turn)) + b
        a, b, c, d = d, to, b, c
    halves = np.empty((*shape, 2), "u4")
    out = []
    for one, two, s, t in ((a, b, *START[:2]), (c, d, *START[2:])):
        np.add(one, np.uint32(s), out=halves[..., 0]), np.add(two, np.uint32(t), out=halves[..., 1])
        out.append(halves.view(">u8")[..., 0].astype("u8"))
    return out[0], out[1]


def slot_blocks(n: int) -> list[tuple[int, int]]:
    """The slots 0 to n in blocks whose names are equally long."""
    ends = [0, *[10 ** k for k in range(1, len(str(n)) + 1) if 10 ** k < n], n]
    return [(at, min(at + BLOCK, hi)) for lo, hi in zip(ends, ends[1:]) for at in range(lo, hi, BLOCK)]


def draws_of(seed: int, pairs: range, stratum: str | None, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(pair of replicates, block number, units drawn by the block's slots in the even one, in the odd one).

    Slot p of replicate r draws the unit at hash(seed, r / 2, stratum, p) mod n, from the first half of the
    digest where r is even and from the second where it is odd. Short blocks are hashed for many pairs together.
    """
    name = "" if stratum is None else f"{stratum}:"
    for k, (lo, hi) in enumerate(slot_blocks(n)):
        long, words, at = len(str(lo)), {}, pairs.start
        while at < pairs.stop:
            size = len(f"{seed}:{at}:{name}".encode())
            upto = min(pairs.stop, at + max(1, LANES // (hi - lo)), 10 ** len(str(at)))  # equally long numbers
            heads = [f"{seed}:{pair}:{name}".encode() for pair in range(at, upto)]
            if (hi - lo) * len(heads) >= FEW and size + long <= 55:
                if size % 4 not in words:
                    words[size % 4] = slot_words(lo, hi, size % 4)
                halves = digests(heads, long, words[size % 4])
            else:
                slots = [str(p).encode() for p in range(lo, hi)]
                found = np.frombuffer(b"".join([md5(head + s).digest() for head in heads for s in slots]), ">u8").astype("u8")
                halves = tuple(found.reshape(len(heads), hi - lo, 2)[..., i] for i in range(2))
            even, odd = ((v - v // np.uint64(n) * np.uint64(n)).view("i8") for v in (v >> np.uint64(4) for v in halves))  # quicker than the remainder
            for pair, one, two in zip(range(at, upto), even, odd):
                yield pair, k, one, two
            at = upto


def drawn(seed: int, reps: range, stratum: str | None, n: int, kind: str = "f8") -> np.ndarray:
    """How often each replicate draws each of n units."""
    starts = [lo for lo, _ in slot_blocks(n)]
    units = np.empty((len(reps), n), dtype="i4")
    for pair, k, *both in draws_of(seed, range(reps.start // 2, (reps.stop + 1) // 2), stratum, n):
        for r, u in zip((2 * pair, 2 * pair + 1), both):
            if r in reps:
                units[r - reps.start, starts[k]:starts[k] + len(u)] = u
    out = np.empty((len(reps), n), kind)
    for i, u in enumerate(units):
        out[i] = np.bincount(u, minlength=n)
    return out


def batches(lo: int, hi: int, n: int) -> Iterator[range]:
    """Replicates lo to hi in parts whose matrices stay small."""
    step = max(2, CELLS // max(1, n) // 2 * 2)
    for at in range(lo, hi, step):
        yield range(at, min(hi, at + step))


def credit_matrix(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Credits of all pairs of rows: one half if near in x or in y, one if ordered the same way, else none; also of copies of a row."""
    dx, dy = x[:, None] - x, y[:, None] - y
    with np.errstate(invalid="ignore"):
        tied = (np.abs(dx) < tol) | (np.abs(dy) < tol)
        return np.where(tied, 0.5, (dx * dy > 0).astype(float))


def value_blocks(v: np.ndarray, tol: float, size: int | None = None) -> list[np.ndarray] | None:
    """Rows in blocks of rising values, none near a value of another block; None if unknown or infinite values or long chains of near ones forbid it."""
    if not np.isfinite(v).all():
        return None
    order = np.argsort(v, kind="stable")
    size = size or max(256, math.isqrt(len(v)))
    heads = np.flatnonzero(np.concatenate([[True], ~(np.diff(v[order]) < tol)]))
    runs, cuts, at = np.diff(np.append(heads, len(v))), [], 0
    for head, run in zip(heads.tolist(), runs.tolist()):
        if head > at and (head + run - at > size):
            cuts.append(head)
            at = head
    blocks = np.split(order, cuts)
    return blocks if all(len(b) <= 2 * SQUARE or v[b[-1]] - v[b[0]] < tol for b in blocks) else None


def inner_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, blocks: list[np.ndarray], v: np.ndarray, apart: np.ndarray | None, tol: float) -> np.ndarray:
    """Twice the credits of pairs of rows inside one of `blocks` of `v`, each row with itself too; none for rows with equal `apart`."""
    out = np.zeros(len(w))
    for rows in blocks:
        mine = w[:, rows]
        if v[rows[-1]] - v[rows[0]] < tol and len(rows) > 1:  # all near each other
            met = mine.sum(1) ** 2
            if apart is not None:
                inside = rows[np.argsort(apart[rows], kind="stable")]
                heads = np.flatnonzero(np.concatenate([[True], np.diff(apart[inside]) != 0]))
                met -= (np.add.reduceat(w[:, inside], heads, axis=1) ** 2).sum(1)
            out += met / 2
        else:
            c = credit_matrix(x[rows], y[rows], tol)
            if apart is not None:
                c[apart[rows][:, None] == apart[rows]] = 0
            # halves up to the number of rows are exact in single precision
            out += np.einsum("rn,rn->r", (mine.astype("f4") @ c.astype("f4")).astype("f8"), mine)
    return out


def grid_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, xs: list[np.ndarray], ys: list[np.ndarray], tol: float) -> np.ndarray:
    """Credits of all pairs of known rows, also of copies of a row: pairs in one block of y by their credits, then those in
    one block of x only; the others are ordered like their blocks and counted from sums over the grid of blocks."""
    bx, by = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    for places, blocks in ((bx, xs), (by, ys)):
        for i, rows in enumerate(blocks):
            places[rows] = i
    twice = inner_sums(x, y, w, ys, y, None, tol) + inner_sums(x, y, w, xs, x, by, tol) - w.sum(1) / 2
    out, cell = np.empty(len(w)), by * len(xs) + bx
    for r, v in enumerate(w):
        grid = np.bincount(cell, weights=v, minlength=len(ys) * len(xs)).reshape(len(ys), len(xs))
        below = grid.cumsum(0).cumsum(1)
        out[r] = twice[r] / 2 + (grid[1:, 1:] * below[:-1, :-1]).sum()
    return out


class Steps:
    """Credits of all pairs of known rows where one of the scores has few values, made ready for many weightings.

    Rows stand in blocks of the other score, and in a block by their class of the first. Pairs inside a block go by their
    credits; a row meets those of earlier blocks by the sums of their classes, one half in its own.
    """

    def __init__(self, order: np.ndarray, cuts: np.ndarray, cls: np.ndarray, first: np.ndarray, other: np.ndarray, tol: float):
        self.order, self.cuts, self.classes = order, cuts, int(cls.max()) + 1
        self.first, self.other, self.tol = first[order], other[order], tol
        self.cls = cls[order]
        self.ladder = np.triu(np.ones((self.classes, self.classes), "f4"), 1) + np.eye(self.classes, dtype="f4") / 2
        self.kept = [self.block(lo, hi) for lo, hi in zip(cuts, cuts[1:])] if (np.diff(cuts) ** 2).sum() <= HELD else None

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, tol: float) -> Steps | None:
        """None where both scores have many values, or long runs of near ones, or some are unknown."""
        if len(x) <= SQUARE or not (np.isfinite(x).all() and np.isfinite(y).all()):
            return None
        for few, many in ((x, y), (y, x)):
            up = np.argsort(few, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], ~(np.diff(few[up]) < tol)]))
            tails = np.append(heads[1:], len(few)) - 1
            if len(heads) > min(CLASSES, len(few) // 8) or not (few[up[tails]] - few[up[heads]] < tol).all():
                continue
            place = np.empty(len(few), np.int64)
            place[up] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(few))))
            blocks = value_blocks(many, tol, STRIP)
            if blocks is None or max(map(len, blocks)) > 8 * STRIP:
                continue
            order = np.concatenate([b[np.argsort(place[b], kind="stable")] for b in blocks])
            return cls(order, np.cumsum([0, *map(len, blocks)]), place, few, many, tol)
        return None

    def block(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half the credits of pairs of the block, where its classes begin, and which they are."""
        c = self.cls[lo:hi]
        heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        return credit_matrix(self.first[lo:hi], self.other[lo:hi], self.tol).astype("f4"), heads, c[heads]

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Credits of each weighting (rows of `w`, single precision, columns as `order` says), also of copies of a row."""
        twice, across, below = -w.sum(1, dtype="f8") / 2, np.zeros(len(w)), np.zeros((len(w), self.classes), "f4")
        for i, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
            credit, heads, which = self.kept[i] if self.kept else self.block(lo, hi)
            mine = w[:, lo:hi]
            met, grid = mine @ credit, np.add.reduceat(mine, heads, axis=1)
            if 2 * float(grid.sum(1).max()) ** 2 >= 1 << 24:  # beyond what single precision adds without loss
                met, mine = met.astype("f8"), mine.astype("f8")
            twice += np.einsum("ri,ri->r", met, mine)
            if i:
                across += np.einsum("rk,rk->r", (below @ self.ladder[:, which]).astype("f8"), grid.astype("f8"))
            below[:, which] += grid
        return twice / 2 + across


def pair_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(correct, pairs) of each weighting (rows of `w`): copies of a row are rows of their own.

    A pair with an unknown score is wrong unless its other scores are near each other.
    """
    pairs = w.sum(1) * (w.sum(1) - 1) / 2
    if len(x) <= SQUARE:
        c = credit_matrix(x, y, tol)
        # halves up to the number of rows are exact in single precision
        met = w.astype("f4") @ c.astype("f4") if w.sum(1).max(initial=0) < 1 << 22 else w @ c
        return (np.einsum("rn,rn->r", met.astype("f8"), w) - w @ np.diag(c)) / 2, pairs
    blocks = [value_blocks(v, tol) for v in (x, y)] if w.sum(1).max(initial=0) < 1 << 22 else [None]
    if all(b is not None for b in blocks):
        return grid_sums(x, y, w, *blocks, tol), pairs
    kx, ky = ~np.isnan(x)[:, None], ~np.isnan(y)[:, None]
    columns = np.ascontiguousarray(w.T)
    near = near_partners(x, y, columns, tol)
    ties = (near["x"] - kx) + (near["y"] - ky) - (near["xy"] - (kx & ky))
    return (columns * (near["below"] + ties / 4)).sum(0), pairs  # each tied pair is met from both ends


def alike(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`rows` with those of equal scores side by side, and where each such run begins: they act like copies of one row."""
    order = rows[np.lexsort((y[rows], x[rows]))]
    a, b = x[order], y[order]
    new = ((a[1:] != a[:-1]) & ~(np.isnan(a[1:]) & np.isnan(a[:-1]))) | ((b[1:] != b[:-1]) & ~(np.isnan(b[1:]) & np.isnan(b[:-1])))
    return order, np.flatnonzero(np.concatenate([[True], new]))


def unit_places(units: pd.Series) -> np.ndarray:
    """Places of the units in rising order, an unknown unit first."""
    codes, _ = pd.factorize(units, sort=True)
    return codes + int((codes < 0).any())


def in_batches(df: DataFrame, keys: Sequence[str], replicates: int, per_task: int, draws: int = 0) -> DataFrame:
    """`df` once for each batch of replicates: columns _lo and _hi; a task holds whole (keys, batch) groups.

    The tasks' work is their replicates, not their bytes, so the number of partitions is set here: more of them for
    many `draws` in all, so that groups that fall together do not hold up the rest.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, min(MOST, draws // SHARE))
    starts = F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(max(1, per_task)))
    cut = df.withColumn("_lo", F.explode(starts)).withColumn("_hi", F.least(F.col("_lo") + max(1, per_task), F.lit(replicates)))
    return cut.repartition(parts, *keys, "_lo")


def one_task(df: DataFrame) -> bool:
    """Whether all rows of `df` may be held by a task."""
    limit = group_rows(df.sparkSession)
    return df.limit(limit + 1).count() <= limit


def listed_draws(df: DataFrame, strata: Sequence[str], unit: str, largest: int, replicates: int, seed: int) -> DataFrame:
    """(rep, strata, unit, w): how often each replicate draws each unit; strata, of at most `largest` rows, fit a task.

    Units are numbered in rising order, an unknown one first. A task makes a batch of replicates of a stratum, small
    enough that its rows are few."""
    strata = list(strata)
    name = F.lit(None).cast("string")
    if strata:
        name = F.when(F.coalesce(*[F.col(k).cast("string") for k in strata]).isNotNull(), F.concat_ws(":", *[F.col(k).cast("string") for k in strata]))
    rows = df.select(*strata, unit, name.alias("_stratum"))

    def evaluate(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(unit, "ascending")], null_placement="at_start"))
        lo, hi, text = table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py(), table.column("_stratum")[0].as_py()
        w = drawn(seed, range(lo, hi), text, len(table)).astype("i8")
        rep, place = np.nonzero(w)
        picked = table.select([*strata, unit]).take(pa.array(place))
        columns = [pa.array((rep + lo).astype("i4")), *picked.columns, pa.array(w[rep, place])]
        return pa.Table.from_arrays(columns, names=["rep", *strata, unit, "w"])

    schema = ", ".join(["rep int", *[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*strata, unit]], "w long"])
    per_task = min(50, max(2, CELLS // 2 // max(1, largest) // 2 * 2))
    return in_batches(rows, strata, replicates, per_task).groupBy(*strata, "_lo").applyInArrow(evaluate, schema)


def accuracy_draws(oof: DataFrame, replicates: int, seed: int, by: Sequence[str], stratum: str, per_task: int = 500, total: int = 0) -> DataFrame:
    """(by, stratum, rep, correct, pairs) of every replicate; each stratum with all its models fits a task. `total`: rows of `oof`."""
    by = list(by)
    names = [*by, stratum]
    schema = ", ".join([f"`{k}` {oof.schema[k].dataType.simpleString()}" for k in names] + ["rep int", "correct double", "pairs double"])

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        place = unit_places(pdf["item"])
        n = int(place.max()) + 1
        text = pdf["_stratum"].iloc[0]
        text = None if text is None or text != text else text
        x, y = pdf["true_score"].to_numpy(float), pdf["predicted_score"].to_numpy(float)
        groups = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(pdf), int)
        rows = [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
        rows = [alike(x, y, r) for r in rows]
        steps = [Steps.of(x[r[heads]], y[r[heads]], 1e-10) for r, heads in rows]
        single = n < 1 << 22 and all(len(heads) == len(r) and len(r) <= n for r, heads in rows)  # a replicate draws n units
        out = []
        for reps in batches(int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0]), n):
            w = drawn(seed, reps, text, n, "f4" if single else "f8")
            for (r, heads), step in zip(rows, steps):
                if single and step:
                    mine = w.take(place[r[step.order]], axis=1)
                    drew = mine.sum(1, dtype="f8")
                    correct, pairs = step.sums(mine), drew * (drew - 1) / 2
                else:
                    mine = w[:, place[r]].astype("f8")
                    if len(heads) < len(r):
                        mine = np.add.reduceat(mine, heads, axis=1)
                    if step and mine.sum(1).max(initial=0) < 1 << 22:
                        drew = mine.sum(1)
                        correct, pairs = step.sums(mine[:, step.order].astype("f4")), drew * (drew - 1) / 2
                    else:
                        correct, pairs = pair_sums(x[r[heads]], y[r[heads]], mine)
                some = mine.sum(1) > 0
                part = pd.DataFrame({"rep": np.arange(reps.start, reps.stop, dtype="int32"), "correct": correct, "pairs": pairs})[some]
                out.append(part.assign(**{k: [pdf[k].iloc[r[0]]] * len(part) for k in names})[[*names, "rep", "correct", "pairs"]])
        return pd.concat(out)

    rows = oof.select(*names, "item", F.col("true_score").cast("double").alias("true_score"), F.col("predicted_score").cast("double").alias("predicted_score"), F.col(stratum).cast("string").alias("_stratum"))
    return in_batches(rows, [stratum], replicates, per_task, total * replicates).groupBy(stratum, "_lo").applyInPandas(evaluate, schema)


def class_draws(probs: DataFrame, row: str, levels: Sequence[int], cols: Sequence[str], replicates: int, seed: int, per_task: int = 250) -> DataFrame:
    """(rep, label, tp, support, predicted, auroc) of every replicate of the rows of `probs`, which fit a task.

    The scores of a class are sorted once for all replicates; AUROC is NULL for a class without both outcomes.
    """
    levels = [int(v) for v in levels]

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        place, truth = unit_places(pdf[row]), pdf["y_true"].to_numpy(float)
        known = np.flatnonzero(~np.isnan(truth))
        truth, p = truth[known], pdf[list(cols)].to_numpy(float)[known]
        answer = np.argmax(np.where(np.isnan(p), -np.inf, p), axis=1)
        n = int(place.max()) + 1
        out = []
        for reps in batches(int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0]), n):
            w = drawn(seed, reps, None, n)[:, place[known]]
            for label in levels:
                hit, said = truth == label, answer == label
                counts = w @ np.column_stack([hit & said, hit, said]).astype(float)
                out.append(pd.DataFrame({"rep": np.arange(reps.start, reps.stop, dtype="int32"), "label": label, "tp": counts[:, 0], "support": counts[:, 1], "predicted": counts[:, 2],
                                         "auroc": area(p[:, label], hit, w) if label < p.shape[1] else np.nan}))
        return pd.concat(out)

    rows = probs.select(row, F.col("y_true").cast("long").alias("y_true"), *[F.col(c).cast("double").alias(c) for c in cols])
    return in_batches(rows, [], replicates, per_task).groupBy("_lo").applyInPandas(evaluate, "rep int, label long, tp double, support double, predicted double, auroc double").withColumn(
        "auroc", F.when(~F.isnan("auroc"), F.col("auroc")))


def area(p: np.ndarray, hit: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Area under the curve for each weighting (rows of `w`), equal scores one half; nan without both outcomes."""
    known = np.flatnonzero(~np.isnan(p))
    order = known[np.argsort(p[known], kind="stable")]
    if not len(order):
        return np.full(len(w), np.nan)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(p[order]) != 0]))
    yes = np.add.reduceat(w[:, order] * hit[order], heads, axis=1)
    no = np.add.reduceat(w[:, order] * ~hit[order], heads, axis=1)
    below = np.cumsum(no, axis=1) - no / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return (yes * below).sum(1) / (yes.sum(1) * no.sum(1))


def median_draws(df: DataFrame, unit: str, value: str, replicates: int, seed: int, per_task: int = 250) -> DataFrame:
    """(rep, value): median of every replicate of the rows, which fit a task; unknown values are left out of it."""

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        place, v = unit_places(pdf[unit]), pdf[value].to_numpy(float)
        known = np.flatnonzero(~np.isnan(v))
        order = known[np.argsort(v[known], kind="stable")]
        n, out = int(place.max()) + 1, []
        for reps in batches(int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0]), n):
            upto = np.cumsum(drawn(seed, reps, None, n)[:, place[order]], axis=1)
            got = np.full(len(reps), np.nan)
            for i, u in enumerate(upto):
                if len(u) and u[-1] > 0:
                    k = int(u[-1])
                    got[i] = (v[order[np.searchsorted(u, (k - 1) // 2, "right")]] + v[order[np.searchsorted(u, k // 2, "right")]]) / 2
            out.append(pd.DataFrame({"rep": np.arange(reps.start, reps.stop, dtype="int32"), "value": got}))
        return pd.concat(out)

    rows = df.select(unit, F.col(value).cast("double").alias(value))
    return in_batches(rows, [], replicates, per_task).groupBy("_lo").applyInPandas(evaluate, "rep int, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def middle_codes(df: DataFrame, order: str, replicates: int, seed: int, middle: int, per_task: int = 50) -> DataFrame:
    """(rep, lo, hi): codes of the two middle values of every replicate, null without known values, for any number of rows.

    `df` has for each row its 0-based place `order` and the code of its value, null if unknown: 0 below and `middle` + 1
    above the values coded one by one. A task holds the codes alone, and hashes and counts the draws block by block.
    """
    kind = "short" if middle + 3 < 1 << 15 else "int"
    unknown = middle + 2

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.asarray(c) for c in pdf.sort_values("_chunk")["_codes"]])
        lo, hi, n = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0]), len(codes)
        counts = np.zeros((hi - lo, unknown + 1), dtype=np.int64)
        for pair, _, *units in draws_of(seed, range(lo // 2, (hi + 1) // 2), None, n):
            for r, u in zip((2 * pair, 2 * pair + 1), units):
                if lo <= r < hi:
                    counts[r - lo] += np.bincount(codes[u], minlength=unknown + 1)
        upto = np.cumsum(counts[:, :unknown], axis=1)
        got = [np.searchsorted(u, [(u[-1] - 1) // 2, u[-1] // 2], "right") if u[-1] else (-1, -1) for u in upto]
        return pd.DataFrame({"rep": np.arange(lo, hi, dtype="int32"), "lo": [int(g[0]) for g in got], "hi": [int(g[1]) for g in got]})

    code = F.coalesce(F.col("_code"), F.lit(unknown)).cast(kind)
    chunks = df.groupBy(F.floor(F.col(order) / F.lit(1 << 16)).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), code.alias("code")))).alias("_s"))
    chunks = cut_lineage(chunks.select("_chunk", F.col("_s.code").alias("_codes")))
    d = in_batches(chunks, [], replicates, per_task).groupBy("_lo").applyInPandas(evaluate, "rep int, lo int, hi int")
    return d.select("rep", *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("lo", "hi")])


def weighted_sums(df: DataFrame, unit: str, values: dict[str, Column], replicates: int, seed: int, per_task: int = 250) -> DataFrame:
    """(rep, sums of w * value for each of `values`, w): weighted sums of every replicate of the rows, which fit a task."""
    names = list(values)

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        place, v = unit_places(pdf[unit]), np.nan_to_num(pdf[names].to_numpy(float))
        n, out = int(place.max()) + 1, []
        for reps in batches(int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0]), n):
            w = drawn(seed, reps, None, n)[:, place]
            out.append(pd.DataFrame(w @ v, columns=names).assign(rep=np.arange(reps.start, reps.stop, dtype="int32"), w=w.sum(1)))
        return pd.concat(out)[["rep", *names, "w"]]

    rows = df.select(unit, *[c.cast("double").alias(k) for k, c in values.items()])
    return in_batches(rows, [], replicates, per_task).groupBy("_lo").applyInPandas(evaluate, ", ".join(["rep int", *[f"`{k}` double" for k in names], "w double"]))
