"""Similarity join on word shingles with trees over count vectors.

A document's distinct shingles are hashed into groups; the counts of the groups are its point. The overlap
of two documents is at most the sum of the smaller counts, coordinate by coordinate, and the same holds
for a box around points with its largest counts. Two steps use this:

* The directory splits documents into families that cannot link with each other. Documents that link
  differ in at most r shingles, so of any r + t groups that both rank highest, t groups are the same in
  both. Each document files under its r + t fullest groups, keyed by their content. The t - 1 of them that
  most documents share are then left out: of t shared keys the rarest stays on both sides. So documents
  that share a passage or a few small groups by chance fall into no common family, however many there are.
* Inside a family a tree of boxes finds, for each point, those whose bound reaches the threshold; the
  shingle sets of these pairs decide. Pairs already connected are skipped: only components are asked for.

Equal sets are collapsed first. Cells are reduced to a star around their smallest member, first within
each task and then over all, so that no cell is gathered, and large families are cut into chunks that meet two by two in tasks of
bounded size, so no task or driver ever holds a whole family, and no pairs of copies are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from prefrank.llm.common import BROADCAST_BYTES, pieces, sent_if_small, tidy, written
from prefrank.llm.components import components
from prefrank.llm.words import Remembered

#: Defaults, those of op3: shingles of 4 words, linked if 100 * intersection >= 85 * union.
PERCENT = 85
SHINGLE = 4
LEAF = 16
#: Keys carry their level in the lowest bits.
LEVELS = 32
#: Most keys of a level that linked documents share for certain (t above).
SURE = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, k: int = SHINGLE, remembered: int = 200_000):
        self.k, self.words = k, Remembered(xxhash.xxh3_64_intdigest, remembered)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """A-Z lower-cased, words between ASCII white space; bytes do both. Fewer words than k are one shingle."""
        parts = (text or b"").lower().split()
        h = np.fromiter(map(self.words.__getitem__, parts), "u8", len(parts))
        if not parts:
            return h
        k = min(self.k, len(parts))
        s = np.full(len(parts) - k + 1, k, "u8")
        for i in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
        return np.unique(mixed(s))


def most_partner(n: int, percent: int = PERCENT) -> int:
    return 100 * n // percent


def needed(a, b, percent: int = PERCENT):
    """Smallest intersection of linked sets of sizes a and b: ceil(percent * (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


def differences(n: int, percent: int = PERCENT) -> int:
    """Most elements in which a set of n and a partner can differ, both ways: sum of sizes - 2 * intersection."""
    return (100 - percent) * (n + most_partner(n, percent)) // (100 + percent)


def sure(level: int) -> int:
    """Keys of a level that linked documents share at least; few where sets are small."""
    return max(1, min(SURE, 2 ** level // 2))


def group_count(level: int, percent: int = PERCENT) -> int:
    """Groups at a level of sets below 2 ** (level + 1): half as many again as keys at most, so that few keys are of empty groups."""
    return max(2 ** (level + 1) // 5, 3 * (differences(2 ** (level + 1), percent) + sure(level)) // 2)


def directory_keys(u: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the fullest groups of a set, at its level and, if a partner may be there, the next.

    The level of a pair is that of its larger set. Groups rank by count, then key: an order that depends on
    the group's content alone, as the argument above needs.
    """
    n = len(u)
    level = n.bit_length() - 1
    keys = []
    weight = np.concatenate([np.zeros(1, "u8"), np.cumsum(mixed(u + np.uint64(1)))])
    for at in (level, level + 1) if most_partner(n, percent) >> (level + 1) else (level,):
        m = group_count(at, percent)
        group = ((u >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype("i8")
        count = np.bincount(group, minlength=m)
        ends = np.cumsum(count)
        content = weight[ends] - weight[ends - count]
        key = mixed(content ^ mixed(np.arange(m, dtype="u8") + np.uint64((at << 40) + 1)))
        key = key & ~np.uint64(LEVELS - 1) | np.uint64(at)
        keys.append(key[np.lexsort((key, -count))[:differences(n, percent) + sure(at)]])
    return np.concatenate(keys).view("i8")


@tidy
def described(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """doc_id, n, fingerprint of the set (128 bits) and directory keys of each document."""
    shingles = Shingler(shingle)
    for b in pieces(batches):
        sets = [shingles(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), "i8") for u in sets]).reshape(-1, 2)
        keys = [directory_keys(u, percent) if len(u) else np.zeros(0, "i8") for u in sets]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("i4")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(u) for u in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))], names=["doc_id", "n", "p", "q", "keys"])


def rare_cells(filed: DataFrame) -> DataFrame:
    """Of rows (cell, node), those whose cell several nodes share, less each node's `sure(level) - 1` largest cells of a level.

    Cells are ordered by size, then key, for all nodes alike. Nodes that share `sure(level)` cells or more
    still share the smallest of them: the others stand before it on both sides.
    """
    shared = filed.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("cell"))).where("size > 1")
    level = F.col("cell").bitwiseAND(F.lit(LEVELS - 1).cast("long"))
    least = F.greatest(F.lit(1.0), F.least(F.lit(float(SURE)), F.pow(F.lit(2.0), level - 1)))
    place = F.row_number().over(W.partitionBy("node", "level").orderBy(F.desc("size"), "cell"))
    return shared.withColumn("level", level).withColumn("place", place).where(F.col("place") >= least).select("cell", "node")


def stars(cell: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by cell and node, and for each row in it the smallest node of its cell."""
    order = np.lexsort((node, cell))
    first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
    return order, np.repeat(node[order][first], np.diff(np.append(first, len(order))))


@tidy
def local_stars(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Combine the cells of a task: the smallest node of a cell stays in it, the others become links to it.

    So a cell brings at most a row from every `rows` rows to the shuffle. Links travel under keys of their own.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def combined() -> pa.RecordBatch:
        cell, node = (np.concatenate(x) for x in zip(*held))
        order, top = stars(cell, node)
        cell, node = cell[order], node[order]
        link = node != top
        again = np.concatenate([[False], (np.diff(cell) == 0) & (np.diff(node) == 0)])
        cell = np.where(link, mixed(node.astype("u8")).view("i8"), cell)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(node), pa.array(top, mask=~link)], names=["cell", "node", "top"]).filter(pa.array(~again))

    for b in batches:
        held.append((b.column("cell").to_numpy(), b.column("node").to_numpy()))
        if sum(len(c) for c, _ in held) >= rows:
            yield combined()
            held = []
    if held:
        yield combined()


@tidy
def linked_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of each node to the smallest of its cell; rows come ordered by cell and node."""
    last = (None, None)
    for b in batches:
        cell, node, given = b.column("cell").to_numpy(), b.column("node").to_numpy(), b.column("top").is_valid().to_numpy(zero_copy_only=False)
        u, v = [node[given]], [b.column("top").drop_null().to_numpy()]
        cell, node = cell[~given], node[~given]
        if len(cell):
            _, top = stars(cell, node)
            if cell[0] == last[0]:
                top[cell == cell[0]] = last[1]
            last = (cell[-1], top[-1])
            u.append(node[node != top])
            v.append(top[node != top])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


class CountTree:
    """Boxes over count vectors, packed bottom up in order of size and first counts; all boxes hold LEAF children."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.place, self.tops, self.least, self.most = order, [points[order]], [sizes[order]], [sizes[order]]
        while len(self.tops[-1]) > LEAF:
            cuts = np.arange(0, len(self.tops[-1]), LEAF)
            self.tops.append(np.maximum.reduceat(self.tops[-1], cuts, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], cuts))
            self.most.append(np.maximum.reduceat(self.most[-1], cuts))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound on the overlap reaches what a link with their size needs."""
        at = np.arange(len(self.tops[-1]))
        for level in range(len(self.tops) - 1, -1, -1):
            near = at[(self.least[level][at] <= most_partner(size, self.percent)) & (100 * self.most[level][at] >= self.percent * size)]
            bound = np.minimum(self.tops[level][near], point).sum(1, dtype="i8")
            at = near[bound >= needed(size, self.least[level][near], self.percent)]
            if level:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.tops[level - 1])]
        return self.place[at]


def family_links(ids: list[int], sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links that connect what links connect between two chunks of a family (or inside one, if they are equal).

    `first` and `second` are places of the chunks' members. The links form a forest: a pair is verified only
    while its ends are not yet connected.
    """
    sizes = np.array([len(u) for u in sets])
    groups = 1 << int(np.clip(2 * np.median(sizes), 64, 2048) - 1).bit_length()
    points = np.array([np.bincount((u & np.uint64(groups - 1)).astype("i8"), minlength=groups) for u in sets]).astype("u2")
    tree, root = CountTree(points[second], sizes[second], percent), list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in first:
        for j in second[tree.search(points[i], int(sizes[i]))]:
            if (a := top(i)) != (b := top(j)):
                if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= needed(int(sizes[i]), int(sizes[j]), percent):
                    root[max(a, b)] = min(a, b)
                    yield ids[i], ids[j]


@tidy
def tile_links(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Links of each tile; rows of a tile follow each other."""
    shingles = Shingler(shingle)
    key, rows = None, []

    def links() -> pa.RecordBatch:
        ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
        chunk = np.array([r[2] for r in rows])
        _, i, j = key
        # copies of a set link at once, so that the tree holds each set once
        seen: dict[bytes, int] = {}
        same = [(seen.setdefault(u.tobytes() + bytes([bool(c == j)]), k), k) for k, (u, c) in enumerate(zip(sets, chunk))]
        found = [(ids[a], ids[b]) for a, b in same if a != b]
        own = np.array([a == b for a, b in same])
        first, second = np.flatnonzero(own & (chunk == i)), np.flatnonzero(own & (chunk == j))
        if len(first) and len(second):
            found += family_links(ids, sets, first, second, percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])

    for b in pieces(batches):
        for row in zip(*[b.column(c).to_pylist() for c in ("root", "i", "j", "node")], b.column("text").cast(pa.binary()).to_pylist(), b.column("chunk").to_pylist()):
            if row[:3] != key:
                if len(rows) > 1:
                    yield links()
                key, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield links()


def tiles(docs: DataFrame, families: DataFrame, chunk_docs: int, chunk_words: int) -> DataFrame:
    """Texts of family members, a copy for each tile: pairs of chunks of at most about these sizes."""
    length = F.octet_length("text") / 6  # words, roughly; only how finely a family is cut depends on it
    members = docs.join(families, docs["doc_id"] == families["node"]).select("node", "root", "text")
    sums = docs.select("doc_id", length.alias("w")).join(families, F.col("doc_id") == F.col("node")).groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk_docs, F.sum("w") / chunk_words)).cast("int").alias("chunks"))
    cut = members.join(sums, "root").withColumn("chunk", F.pmod(F.xxhash64("node", "root"), F.col("chunks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return pairs.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "text", "chunk")


def link_components(docs: DataFrame, chunk_docs: int = 1024, chunk_words: int = 1 << 20, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (distinct) and component_id of every row: the smallest doc_id that links reach.

    Shingles are of `shingle` words; sets link where 100 * intersection >= `percent` * union. Needs doc_id and text; other columns are left out. A null or empty text, or one of white space, has no
    shingles and links with nothing; its component is its own id. Rows with the same doc_id are one document
    for reachability, whatever their texts. Rows with a null doc_id keep n_shingles, take no part in links
    and get a null component. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(docs.mapInArrow(lambda batches: described(batches, shingle, percent), "doc_id long, n long, p long, q long, keys array<long>"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = known.where("n > 0 AND doc_id IS NOT NULL")
    copies = linked.groupBy("p", "q").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1").select("p", "q", "rep")
    copies = sent_if_small(written(copies))

    def with_rep(rows: DataFrame) -> DataFrame:
        return rows.join(copies, ["p", "q"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))

    cells = rare_cells(with_rep(linked).where("doc_id = rep").select(F.explode("keys").alias("cell"), F.col("rep").alias("node")))
    cells = cells.mapInArrow(local_stars, "cell long, node long, top long").repartition(parts, "cell").sortWithinPartitions("cell", "node")
    families = sent_if_small(written(components(cells.mapInArrow(linked_stars, "u long, v long"))), most=2 * BROADCAST_BYTES)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    tiled = tiles(texts, families, chunk_docs, chunk_words).repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    links = tiled.mapInArrow(lambda batches: tile_links(batches, shingle, percent), "u long, v long")
    members = with_rep(linked.select("doc_id", "p", "q")).select("doc_id", "rep")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").select("doc_id", "v")
    same_id = members.join(several, "doc_id").where("rep > v").select(F.col("rep").alias("u"), "v")
    roots = sent_if_small(written(components(links.unionAll(same_id)).withColumnRenamed("node", "rep")))
    rows = with_rep(known.select("doc_id", "n", "p", "q")).join(roots, "rep", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` without those that a smaller doc_id links to; its columns only.

    Of rows with the same doc_id that have words, the first text stays. Rows without words or without an id stay.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    gone = link_components(docs, shingle=shingle, percent=percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    with_words = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = docs.where(with_words)
    # Only texts of repeated ids are put in order; the others stay where they are if few ids repeat and few are gone.
    several = texts.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("__id")
    several, gone = (sent_if_small(written(ids), most=2 * BROADCAST_BYTES) for ids in (several, gone))
    own = F.col("doc_id") == F.col("__id")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text")))
    firsts = texts.join(several, own, "left_semi").withColumn("__row", first).where("__row = 1")
    chosen = texts.join(several, own, "left_anti").select(*names).unionAll(firsts.select(*names)).join(gone, own, "left_anti")
    return chosen.unionAll(docs.where(~with_words).select(*names))
