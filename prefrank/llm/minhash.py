"""Near-duplicates by MinHash with sequential Bayesian verification.

A document's set of word shingles gets a signature: for each of `bands` x `rows` hash functions the smallest
value over the set. Two sets agree in a value with a probability equal to their similarity s. Values are put
together in bands; documents that share a band are candidates, so a pair at similarity s is missed with
probability (1 - s ** rows) ** bands: below one in 100,000 at 0.8 with 64 bands of 8.

Candidates are compared a batch of values at a time. With a uniform prior, m agreements in n values leave a
posterior probability of s >= t that equals P(Binomial(n + 1, t) <= m); once it is below `miss` the pair is
dropped. What survives all batches is decided on the full sets.

Equal sets are collapsed first. A band that many documents share is reduced to links to its smallest member
within each task, so no cell is gathered. What such links connect is a family, and only families are
compared, in two rounds of tasks of bounded size: each chunk of a family with the family's smallest document;
then, in families of several chunks, those outside the largest component found so far against all others. So
a family whose members link with each other is sent once, however large it is, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prefrank.llm.common import pieces, sent_if_small, tidy, written
from prefrank.llm.components import components
from prefrank.llm.jaccard import Shingler, linked_stars, local_stars, mixed

#: Elements times functions hashed at once.
BLOCK = 1 << 18


class Signer:
    """MinHash signatures of sets of 64-bit hashes and the keys of their bands."""

    def __init__(self, bands: int = 64, rows: int = 8):
        self.bands, self.rows = bands, rows
        draws = mixed(np.arange(1, 2 * bands * rows + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
        self.factor, self.shift = (draws[:bands * rows] >> np.uint64(32)).astype("u4") | np.uint32(1), (draws[bands * rows:] >> np.uint64(32)).astype("u4")
        self.step = max(1, BLOCK // (bands * rows))

    def signature(self, u: np.ndarray) -> np.ndarray:
        """Values of all functions; the set is hashed in blocks, so that memory does not grow with it."""
        x = ((u >> np.uint64(32)) ^ u).astype("u4")[:, None]
        low = np.full(len(self.factor), np.iinfo("u4").max, "u4")
        for at in range(0, len(x), self.step):
            np.minimum(low, ((x[at:at + self.step] ^ self.shift) * self.factor).min(0), out=low)
        return low

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Bands of each signature as 64-bit keys; the number of the band is part of the key."""
        part = signatures.reshape(len(signatures), self.bands, self.rows).astype("u8")
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype="u8"), part.shape[:2])
        for i in range(self.rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i])
        return key.view("i8")


def fewest_agreements(n: int, percent: int, miss: float) -> int:
    """Least m of n agreements at which P(Binomial(n + 1, percent / 100) <= m) reaches `miss`."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


@tidy
def described(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n, fingerprint of the set (128 bits) and the band keys of each document."""
    shingles, signer = Shingler(shingle), Signer(bands, rows)
    for b in pieces(batches):
        sets = [shingles(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), "i8") for u in sets]).reshape(-1, 2)
        keys = signer.keys(np.array([signer.signature(u) for u in sets], "u4").reshape(len(sets), -1))
        filled = np.array([len(u) > 0 for u in sets], bool)
        offsets = np.concatenate([[0], np.cumsum(filled * bands)]).astype("i4")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(u) for u in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].ravel()))], names=["doc_id", "n", "p", "q", "bands"])


def verified(sets: list[np.ndarray], label: np.ndarray, own: np.ndarray, signer: Signer, percent: int, miss: float, batch: int = 64) -> list[tuple[int, int]]:
    """Links (places of `sets`) that connect what linked candidates connect, with at least one end in `own`.

    Members with equal `label` are connected already. Each member meets the candidates before it that are
    not yet connected with it; batches of values drop most, full sets decide the rest.
    """
    signatures = np.array([signer.signature(u) for u in sets])
    keys, sizes = signer.keys(signatures), np.array([len(u) for u in sets])
    codes = np.unique(keys, return_inverse=True)[1].reshape(keys.shape)
    label, found = label.copy(), []
    limits = [(at, min(at + batch, signatures.shape[1])) for at in range(0, signatures.shape[1], batch)]
    limits = [(a, z, fewest_agreements(z, percent, miss)) for a, z in limits]
    for i in range(1, len(sets)):
        open_ = (label[:i] != label[i]) & (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i]))
        if not own[i]:
            open_ &= own[:i]
        near = np.flatnonzero(open_)
        near = near[(codes[near] == codes[i]).any(1)]
        agree = np.zeros(len(near), int)
        for a, z, least in limits:
            agree += (signatures[near, a:z] == signatures[i, a:z]).sum(1)
            near, agree = near[agree >= least], agree[agree >= least]
            if not len(near):
                break
        for j in near[np.argsort(-agree, kind="stable")]:
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                    found.append((int(i), int(j)))
                    label[label == label[i]] = label[j]
    return found


@tidy
def tile_links(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, bands: int, rows: int, miss: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) found in each tile; rows of a tile (root, i, j) follow each other."""
    shingles, signer = Shingler(shingle), Signer(bands, rows)
    key, members = None, []

    def links() -> pa.RecordBatch:
        unique = {(node, text): (node, text, part, own) for node, text, part, own in members}
        ids = [m[0] for m in unique.values()]
        sets = [shingles(m[1]) for m in unique.values()]
        label = np.unique(np.array([m[2] for m in unique.values()]), return_inverse=True)[1]
        found = verified(sets, label, np.array([m[3] for m in unique.values()]), signer, percent, miss)
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["u", "v"])

    for b in pieces(batches):
        for row in zip(*[b.column(c).to_pylist() for c in ("root", "i", "j", "node")], b.column("text").cast(pa.binary()).to_pylist(), b.column("part").to_pylist(), b.column("own").to_pylist()):
            if row[:3] != key:
                if len(members) > 1:
                    yield links()
                key, members = row[:3], []
            members.append(row[3:])
    if len(members) > 1:
        yield links()


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, bands: int = 64, rows: int = 8, miss: float = 1e-6, chunk_docs: int = 1024, chunk_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles (distinct), component_id (smallest doc_id that links reach) and kept of every row.

    Shingles are of `shingle` words between ASCII white space, A-Z lower-cased; fewer words are one shingle.
    Sets link where 100 * intersection >= `percent` * union, confirmed on the full sets; a link may be missed
    with the probabilities named above (`miss`: for each batch of the comparison). kept holds where doc_id =
    component_id. Needs doc_id and text; other columns are left out. A null or empty text, or one of white
    space, has no shingles and links with nothing; its component is its own id. Rows with the same doc_id are
    one document for reachability, whatever their texts. Rows with a null doc_id keep n_shingles, take no
    part in links and get a null component and kept. Whole texts are hashed, in blocks. An empty table gives
    no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(docs.mapInArrow(lambda b: described(b, shingle, bands, rows), "doc_id long, n long, p long, q long, bands array<long>"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = known.where("n > 0 AND doc_id IS NOT NULL")
    copies = linked.groupBy("p", "q").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1").select("p", "q", "rep")
    copies = sent_if_small(written(copies))

    def with_rep(frame: DataFrame) -> DataFrame:
        return frame.join(copies, ["p", "q"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))

    cells = with_rep(linked).where("doc_id = rep").select(F.explode("bands").alias("cell"), F.col("rep").alias("node"))
    cells = cells.mapInArrow(local_stars, "cell long, node long, top long").repartition(parts, "cell").sortWithinPartitions("cell", "node")
    families = written(components(cells.mapInArrow(linked_stars, "u long, v long")))
    # a member's text may come from several rows of its id; each counts as words, roughly
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumnRenamed("doc_id", "node")
    words = texts.select("node", (F.octet_length("text") / 6).alias("w")).join(sent_if_small(families), "node").groupBy("root", "node").agg(F.sum("w").alias("w"))
    words = written(words)
    weights = words.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk_docs, F.sum("w") / chunk_words)).cast("int").alias("chunks"))
    members = written(words.join(sent_if_small(weights), "root").withColumn("chunk", F.pmod(F.xxhash64("node", "root"), F.col("chunks")).cast("int")))

    def links_of(tiled: DataFrame) -> DataFrame:
        """`tiled`: root, i, j, node, part (component so far), own. Texts travel to their tiles."""
        rows_ = texts.join(sent_if_small(tiled), "node").repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", F.desc("own"), "node")
        return rows_.mapInArrow(lambda b: tile_links(b, shingle, percent, bands, rows, miss), "u long, v long")

    none = F.lit(None).cast("int")
    own_chunk = members.select("root", F.col("chunk").alias("i"), none.alias("j"), "node", F.col("node").alias("part"), F.lit(True).alias("own"))
    several = members.where("chunks > 1")
    leaders = several.where("node = root").select("root", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), none.alias("j"), "node", F.col("node").alias("part"), F.lit(True).alias("own"), "chunk")
    leaders = leaders.where("i <> chunk").drop("chunk")
    first = written(links_of(own_chunk.unionAll(leaders)))
    so_far = components(first)

    # second round: members outside the largest component of a family of several chunks, against all others
    state = written(several.join(sent_if_small(written(so_far.withColumnRenamed("root", "part"))), "node", "left").withColumn("part", F.coalesce("part", "node")))
    sizes = state.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    largest = sizes.groupBy("root").agg(F.max_by(F.struct("part", "n", "w"), F.struct("n", -F.col("part"))).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    bands_of = F.greatest((F.col("n") - F.col("most.n")) / chunk_docs, F.when(F.col("n") > F.col("most.n"), (F.col("w") - F.col("most.w")) / chunk_words).otherwise(0))
    largest = largest.select("root", F.col("most.part").alias("largest"), F.ceil(bands_of).cast("int").alias("bands")).where("bands > 0")
    rest = state.join(sent_if_small(largest), "root").withColumn("cuts", F.greatest("chunks", "bands"))
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("node", "root"), F.col("cuts")).cast("int")).withColumn("out", F.col("part") != F.col("largest"))
    rest = rest.withColumn("band", F.pmod(F.xxhash64("root", "node"), F.col("bands")).cast("int"))
    # tile (chunk i, band j): every member of chunk i meets the outsiders of band j
    meets = rest.select("root", F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("j"), "node", "part", F.lit(False).alias("own"))
    outsiders = rest.where("out").select("root", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"), F.col("band").alias("j"), "node", "part", F.lit(True).alias("own"))
    # an outsider in its own chunk and band stands there once, as an outsider
    tiles = meets.unionAll(outsiders).groupBy("root", "i", "j", "node", "part").agg(F.max("own").alias("own"))
    second = links_of(tiles)

    ids = with_rep(linked.select("doc_id", "p", "q")).select("doc_id", "rep")
    many = ids.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").select("doc_id", "v")
    same_id = ids.join(many, "doc_id").where("rep > v").select(F.col("rep").alias("u"), "v")
    roots = sent_if_small(written(components(first.unionAll(second).unionAll(same_id)).withColumnRenamed("node", "rep")))
    rows_out = with_rep(known.select("doc_id", "n", "p", "q")).join(roots, "rep", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
    return rows_out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
