"""Nearest neighbours by a block matrix join on int8 tiles with error bounds.

Vectors are packed into blocks, queries into smaller ones. A tile is a block of queries against a block of
candidates: one matrix product of 8-bit codes gives all distances up to the quantisation errors of the two
vectors, whose norms are known. Only pairs that these bounds leave among a query's k best are recomputed
in double precision; heaps of k keep the best per query, first within a task, then over all of them.

The result is exact: the bounds drop no true neighbour. Every candidate meets every query, in blocks, as the
search asks for; blocks of queries are broadcast only if their counted size is small, else shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefrank.llm.common import written

BLOCK = "dim int, block int, ids binary, vectors binary"
RESULT = "query_id long, vec_id long, score double"


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, has only finite components, and is not zero throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0))


def packed(df: DataFrame, vector: str, rows: int, parts: int) -> DataFrame:
    """Blocks of at most `rows` vectors of equal length; blocks are numbered within each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        count = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal count
            count += 1
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_pylist([{"dim": dim, "block": count, "ids": np.array(ids, "<i8").tobytes(), "vectors": b"".join(vectors)}], schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for b in batches:
            lists = b.column("vector")
            values, bounds = np.asarray(lists.flatten(), dtype="<f8"), np.concatenate([[0], np.cumsum(lists.value_lengths())])
            for i, vec_id in enumerate(b.column("vec_id").to_pylist()):
                v = values[bounds[i]:bounds[i + 1]]
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                vectors.append(v.tobytes())
                if len(ids) >= rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    even = df.select("vec_id", F.col(vector).cast("array<double>").alias("vector")).repartition(parts, F.xxhash64("vec_id", "vector"))
    return even.mapInArrow(pack, BLOCK)


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes of vectors, their scales, and the norms of what the codes miss."""
    scale = np.abs(v).max(1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    code = np.rint(v / scale[:, None]).astype("int8")
    return code, scale, np.sqrt(((v - code * scale[:, None]) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of code rows: sums below 2^24 are exact in single precision."""
    kind = "float32" if a.shape[1] * 127 * 127 < 1 << 24 else "float64"
    return a.astype(kind) @ b.astype(kind).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, components summed in order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        d = a[:, i] - b[:, i]
        total += d * d
    return np.sqrt(total)


def least(k: int, pairs: Iterable[tuple[float, int]]) -> list[tuple[float, int]]:
    """The k smallest (score, id) pairs of distinct ids, in order; an id counts with its smallest score."""
    best: dict[int, float] = {}
    for score, i in pairs:
        if i not in best or score < best[i]:
            best[i] = score
    return heapq.nsmallest(k, ((score, i) for i, score in best.items()))


def kth_bound(upper: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row, the k-th smallest upper bound over distinct ids, or the largest if they are fewer."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    if len(starts) < len(ids):
        upper = np.minimum.reduceat(upper[:, order], starts, axis=1)
    n = min(k, len(starts))
    return np.partition(upper, n - 1, axis=1)[:, n - 1]


def tile(query: tuple, block: tuple, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query of a tile, the (score, id) pairs that may be among its k best."""
    (q_ids, q), (c_ids, c) = query, block
    (q_code, q_scale, q_error), (c_code, c_scale, c_error) = codes(q), codes(c)
    q_norm, c_norm = ((x.astype("float64") ** 2).sum(1) * s**2 for x, s in ((q_code, q_scale), (c_code, c_scale)))
    square = q_norm[:, None] + c_norm - 2 * q_scale[:, None] * c_scale * products(q_code, c_code)
    # what rounding in the norms and in the subtraction can make of a small distance
    slack = np.sqrt(1e-12 * (q_norm[:, None] + c_norm))
    middle = np.sqrt(np.maximum(square, 0))
    reach = q_error[:, None] + c_error + slack
    middle[q_ids[:, None] == c_ids] = np.inf
    worst = kth_bound(middle + reach, c_ids, k)
    rows, cols = np.nonzero((middle - reach <= worst[:, None]) & np.isfinite(middle))
    scores = distances(q[rows], c[cols])
    bounds = np.searchsorted(rows, np.arange(len(q_ids) + 1))
    for i, q_id in enumerate(q_ids):
        part = slice(bounds[i], bounds[i + 1])
        yield int(q_id), least(k, zip(scores[part].tolist(), c_ids[cols[part]].tolist()))


def merged_tiles(k: int, held: int):
    """mapInPandas function: tiles in, each query's k best of this task out; at most `held` queries at once."""

    def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}

        def flush() -> pd.DataFrame:
            rows = [(q, i, s) for q, pairs in best.items() for s, i in pairs]
            best.clear()
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        for frame in frames:
            for r in frame.itertuples():
                for q, pairs in tile(unpack(r.q_ids, r.q_vectors, r.dim), unpack(r.ids, r.vectors, r.dim), k):
                    best[q] = least(k, best.get(q, []) + pairs)
                if len(best) > held:
                    yield flush()
        yield flush()

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, vector: str = "embedding", query_rows: int = 512, block_rows: int = 2048, broadcast_bytes: int = 32 << 20, held: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates by Euclidean distance, nearest first.

    Both need vec_id and the vector column; other columns are left out. Ties go to the smaller vec_id. The
    candidate with the query's own vec_id takes no part. Rows with a null id and vectors that are null, empty,
    zero, or hold null or non-finite components take no part; vectors of different lengths never meet.
    Repeated (vec_id, vector) rows count once; a vec_id with several vectors keeps its nearest. Fewer than k
    candidates give fewer rows, none or an empty table give none.
    """
    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = packed(usable(queries, vector).dropDuplicates(["vec_id", vector]), vector, query_rows, parts=max(1, parts // 8))
    q = written(q.select("dim", F.monotonically_increasing_id().alias("slot"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    size = q.agg(F.sum(F.octet_length("q_vectors"))).first()[0] or 0
    slots = q.groupBy("dim").agg(F.collect_list("slot").alias("slots"))  # a number per block of queries
    blocks = packed(usable(candidates, vector).dropDuplicates(["vec_id", vector]), vector, block_rows, parts).join(slots, "dim").withColumn("slot", F.explode("slots")).drop("slots", "block")
    side = F.broadcast(q.drop("dim")) if size <= broadcast_bytes else q.drop("dim")
    found = blocks.join(side, "slot").select("dim", "ids", "vectors", "q_ids", "q_vectors").mapInPandas(merged_tiles(k, held), RESULT)

    def best(keys: list[str], frames: DataFrame) -> DataFrame:
        return frames.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k).alias("pairs"))

    # a task of the last step gets k rows per task of the tiles; salted first, so that many tasks stay bearable
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    part = best(["query_id", "salt"], near).select("query_id", F.inline("pairs"))
    return (best(["query_id"], part).select("query_id", F.posexplode("pairs").alias("pos", "pair"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("pair.vec_id").alias("vec_id"), F.col("pair.score").alias("score")))
