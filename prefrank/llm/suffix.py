"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes need an order only through `depth` bytes; suffixes equal that far are exactly the repeated windows.
The digits are taken most significant first, and a group of one is dropped before the next pass:

1. The first digit of a suffix is its anchor: of the grams inside the window the one with the smallest hash,
   so equal windows have equal anchors. Neighbouring suffixes share an anchor, so they travel as one run,
   a hundredth of the suffixes. Runs whose anchor occurs once are dropped.
2. The second digit is the run's whole content: runs equal in it repeat in all their windows.
3. Runs that are left next to others with the same anchor are sorted byte by byte, eight bytes a pass. An
   anchor shared by very many different runs does not go to one task: its windows are counted one by one.

All counts combine before they are shuffled, and joins may split hot keys. The texts are shuffled twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefrank.llm.common import pieces, sent_if_small, written
from prefrank.llm.jaccard import mixed

GRAM = 64
SEGMENT = 1 << 17
RUN = "doc_id long, h long, anchor long, content long, pos long"
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2^64 and of its inverse."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(SEGMENT + 4096, b, "u8")])) for b in (BASE, inverse))


def runs(data: bytes, depth: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """Start, number of windows, anchor and content hash of each run of windows of `depth` bytes.

    Long texts are cut into segments; windows at a cut are the same, only their runs are shorter.
    """
    up, down = powers()
    for base in range(0, len(data) - depth + 1, SEGMENT):
        part = data[base:base + SEGMENT + depth - 1]
        b = np.frombuffer(part, "u1").astype("u8") + np.uint64(1)
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(b * up[:len(b)])])
        grams = mixed((sums[gram:] - sums[:-gram]) * down[:len(b) - gram + 1])
        # smallest hash in each window of grams, the leftmost of equal ones: the place is in the low bits
        least, span, width = grams >> np.uint64(20) << np.uint64(20) | np.arange(len(grams), dtype="u8"), 1, depth - gram + 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        n = len(grams) - width + 1
        least = np.minimum(least[:n], least[width - span:width - span + n])
        place = (least & np.uint64((1 << 20) - 1)).astype("i8")
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.append(starts, n))
        for s, size, anchor in zip(starts.tolist(), sizes.tolist(), grams[place[starts]].view("i8").tolist()):
            content = blake2b(part[s:s + size + depth - 1], digest_size=8).digest()
            yield base + s, size, anchor, int.from_bytes(content, "little", signed=True)


def all_runs(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 128):
        rows = [(i, h, anchor, content, start << 8 | size) for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), b.column("text").cast(pa.binary()).to_pylist())
                for start, size, anchor, content in runs(t, depth, gram)]
        cols = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "h", "anchor", "content", "pos"])


def repeated(buffer: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Places in `starts` of suffixes equal through `depth` bytes to another of their group.

    Most significant digit first, eight bytes a digit; each pass splits the groups and drops groups of one.
    """
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([buffer, np.zeros(8, "u1")]), 8)
    alive = np.arange(len(starts))
    for at in range(0, depth, 8):
        digit = words[starts[alive] + min(at, depth - 8)].copy().view(">u8").ravel()
        order = np.lexsort((digit, group))
        digit, group, alive = digit[order], group[order], alive[order]
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1 if len(group) else new[:0]
        alive, group = alive[several], group[several]
        if not len(alive):
            break
    return alive


def sorted_runs(batches: Iterator[pa.RecordBatch], depth: int, windows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """doc_id, h, lo, hi: bytes covered by repeated windows of lone runs; runs come ordered by anchor."""
    rows: list[tuple] = []
    held = 0

    def spans() -> pa.RecordBatch:
        sizes = np.array([r[5] for r in rows])
        lengths = sizes + depth - 1
        buffer = np.frombuffer(b"".join(r[6] for r in rows), "u1")
        first = np.cumsum(lengths) - lengths
        run = np.repeat(np.arange(len(rows)), sizes)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        found = np.sort(repeated(buffer, first[run] + offset, group[run], depth))
        found = found[np.array([r[1] == 1 for r in rows])[run[found]]]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (run[found[1:]] != run[found[:-1]])])) if len(found) else found
        ends = np.append(begins[1:], len(found)) - 1 if len(found) else found
        out = [(rows[run[a]][2], rows[run[a]][3], rows[run[a]][4] + int(offset[a]), rows[run[a]][4] + int(offset[z]) + depth) for a, z in zip(found[begins], found[ends])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["doc_id", "h", "lo", "hi"])

    for b in pieces(batches):
        for row in zip(*[b.column(c).to_pylist() for c in ("anchor", "total", "doc_id", "h", "start", "size", "data")]):
            if held >= windows and row[0] != rows[-1][0]:
                yield spans()
                rows, held = [], 0
            rows.append(row)
            held += row[5]
    if rows:
        yield spans()


def single_windows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """A row per window of a run: 128 bits of its digest, and where it lies."""
    for b in pieces(batches, 64):
        out = []
        for total, doc_id, h, start, size, data in zip(*[b.column(c).to_pylist() for c in ("total", "doc_id", "h", "start", "size", "data")]):
            for s in range(size):
                d = blake2b(data[s:s + depth], digest_size=16).digest()
                out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), min(total, 2), doc_id, h, start + s))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], names=["a", "b", "total", "doc_id", "h", "lo"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result row and the remaining bytes of each document."""
    for b in pieces(batches, 64):
        out = []
        for doc_id, data, spans in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
            kept, at, removed, n = [], 0, 0, 0
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
                if lo > at or not n:
                    kept.append(data[at:lo])
                    n, removed, at = n + 1, removed + hi - lo, hi
                elif hi > at:
                    removed, at = removed + hi - at, hi
            kept.append(data[at:])
            rest = b"".join(kept)
            out.append((doc_id, len(data), removed, n, sha256(rest).hexdigest(), rest))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id (null matches null) and h; the columns of `left` name the keys."""
    right = right.withColumnRenamed("doc_id", "__id").withColumnRenamed("h", "__h")
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), how).drop("__id", "__h")


def repeated_spans(texts: DataFrame, depth: int, gram: int, largest: int) -> DataFrame:
    """doc_id, h, lo, hi: byte spans that repeated windows cover; spans may overlap. `texts`: doc_id, h, text."""
    long_enough = texts.where(F.octet_length("text") >= depth)
    every = long_enough.mapInArrow(lambda b: all_runs(b, depth, gram), RUN)
    # tables that joins read are written first: only then can a join split a hot key of its other side
    anchors = sent_if_small(written(every.groupBy("anchor").count().where("count > 1").select("anchor")))
    left = written(every.join(anchors, "anchor"))
    contents = left.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("total"), F.min(F.struct("doc_id", "h", "pos")).alias("owner"))
    contents = written(contents)
    groups = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.min("total").alias("least"))
    start, size = F.shiftright("pos", 8), F.col("pos").bitwiseAND(255)
    whole = left.join(contents.where("total > 1").select("anchor", "content"), ["anchor", "content"]).select("doc_id", "h", start.alias("lo"), (start + size + depth - 1).alias("hi"))
    # lone runs that share their anchor, and one of each other run beside them
    open_runs = contents.join(groups.where("members > 1 AND least = 1"), "anchor").select("owner.doc_id", "owner.h", F.struct("anchor", "total", "members", "owner.pos").alias("run"))
    wanted = open_runs.groupBy("doc_id", "h").agg(F.collect_list("run").alias("runs"))
    cut = same_row(long_enough.select("doc_id", "h", F.col("text").cast("binary").alias("data")), wanted, "inner")
    cut = cut.withColumn("run", F.explode(F.array_distinct("runs"))).withColumn("pos", F.col("run.pos"))
    cut = written(cut.select("run.anchor", "run.total", "run.members", "doc_id", "h", start.alias("start"), size.alias("size"), F.substring("data", (start + 1).cast("int"), (size + depth - 1).cast("int")).alias("data")))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = cut.where(F.col("members") <= largest).repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: sorted_runs(b, depth), "doc_id long, h long, lo long, hi long")
    windows = cut.where(F.col("members") > largest).mapInArrow(lambda b: single_windows(b, depth), "a long, b long, total long, doc_id long, h long, lo long")
    again = windows.groupBy("a", "b").agg(F.sum("total").alias("n")).where("n > 1").select("a", "b")
    many = windows.where("total = 1").join(again, ["a", "b"]).select("doc_id", "h", "lo", (F.col("lo") + depth).alias("hi"))
    return whole.unionAll(few).unionAll(many)


def without_repeats(docs: DataFrame, depth: int = 200, gram: int = GRAM, largest: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    Removed is every byte that a string of `depth` bytes covers which also starts elsewhere, in the same
    document or another. Needs doc_id and text; other columns are left out. Texts are compared as UTF-8
    bytes, so what remains may start or end inside a character. A null or empty text has 0 bytes and loses
    none; so do texts shorter than `depth`. A null doc_id is an ordinary id. Repeated rows are documents
    of their own and lose everything from `depth` bytes on. An empty table gives no rows. A task sorts the runs of an anchor
    with at most `largest` different ones; beyond that windows are counted singly, with the same result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    spans = repeated_spans(texts, depth, gram, largest).distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return same_row(texts, spans, "left").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
