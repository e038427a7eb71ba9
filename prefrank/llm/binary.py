"""Token identifiers in Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded in that order and written as Parquet:
identifiers as a dictionary-encoded list column, doc_id and offsets as delta-encoded integers, row groups
and pages of set size, with the page indexes that let a reader fetch the tokens of a few documents, or
only the small columns, without touching the rest. Each file holds offsets relative to its partition;
the partitions' totals, read from the small columns alone, turn them into positions in the whole corpus.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from prefrank.llm.common import pieces, shared_folder, tidy
from prefrank.llm.words import LATIN, Remembered, byte_symbols, coded, latin_pattern

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"
#: Fixed value: how the pre-tokenizer cuts a lower-case text into words; here for Latin texts.
WORDS = latin_pattern(r"'s|'t|'re|'ve|'m|'ll|'d|[LETTER]+|[NUMBER]|[^\sLETTERNUMBER]+")


class Encoder:
    """Identifiers of texts, by the tokenizers library.

    The tokenizer drops white space and merges within words only, so Latin texts are cut at white space,
    the distinct chunks of a batch into words, and the library's model sees each remembered word once. Texts
    that are not Latin before and after lower-casing, and those that may hold the string of a special token,
    go to the library whole.
    """

    def __init__(self, path: str, most: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.words: Remembered[bytes] = Remembered(self.word, most)

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])
        return b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])

    def latin(self, text: str | None) -> str | None:
        """The text in lower case if it can be cut into words here; some capitals have a lower case beyond LATIN."""
        if not text or not LATIN.fullmatch(text):
            return None
        low = text.lower()
        return low if LATIN.fullmatch(low) and not any(s in low for s in self.special) else None

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Identifiers of each text; null has none."""
        low = [self.latin(t) for t in texts]
        chunks, places, bounds = coded(pc.ascii_split_whitespace(pa.array([t for t in low if t is not None], pa.string())))
        words, find, join = self.words, WORDS.findall, b"".join
        known = [join([words[w] for w in find(c)]) for c in chunks]
        sizes = np.array([len(x) // 4 for x in known], dtype="int64")
        starts = np.cumsum(sizes) - sizes
        counts = sizes[places]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((starts[places] - ends[:-1]).astype("int32"), counts)  # a batch has fewer than 2 ** 31 identifiers
        at += np.arange(len(at), dtype="int32")
        flat = np.frombuffer(b"".join(known), dtype="<u4")[at]
        cuts = iter(zip(ends[bounds[:-1]], ends[bounds[1:]]))
        return [flat[slice(*next(cuts))] if cut is not None else self.whole(t) for t, cut in zip(texts, low)]

    def whole(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], dtype="<u4")


@lru_cache(maxsize=4)
def encoder(path: str, remembered: int) -> Encoder:
    return Encoder(path, remembered)


@tidy
def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int, remembered: int) -> Iterator[pa.RecordBatch]:
    """Encode one sorted partition; start_in_part counts the identifiers before a document in it."""
    encode, part, at = encoder(tokenizer, remembered).texts, TaskContext.get().partitionId(), 0
    last = np.array([end], dtype="<u4")
    for b in pieces(batches, 2048):
        ids = encode(b.column("text").to_pylist())
        lengths = np.array([len(x) + 1 for x in ids], dtype="int64")
        ends = np.cumsum(lengths)
        flat = np.concatenate([x for i in ids for x in (i, last)]).astype("int32")
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(ids), part, dtype="int32")), pa.array(at + ends - lengths), pa.array(lengths), tokens], names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
        at += int(lengths.sum())


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end: int = 2, row_group_bytes: int = 32 << 20, page_rows: int = 1000, remembered: int = 60_000) -> None:
    """Write doc_id and the identifiers of whole texts, with `end` after each document, in doc_id order.

    `df` needs doc_id and text; other columns are left out. A null text is written as the end identifier
    alone. A null doc_id sorts first; equal doc_ids are ordered by their texts, so reruns give the same
    files. An empty table gives one file without rows. `folder` must be shared by driver and executors.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    rows = sorted_docs.mapInArrow(lambda batches: encoded(batches, tokenizer, end, remembered), SCHEMA)
    # whole texts travel to the workers in smaller batches than usual while the files are written
    spark, size = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    spark.conf.set(size, str(min(2048, int(usual)) if int(usual) > 0 else 2048))
    try:
        write_rows(rows, folder, row_group_bytes, page_rows)
    finally:
        spark.conf.set(size, usual)


def write_rows(rows: DataFrame, folder: str, row_group_bytes: int, page_rows: int) -> None:
    (rows.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes)
     .option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#start_in_part", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .parquet(folder))


def read_tokens(spark: SparkSession, folder: str, tokens: bool = True) -> DataFrame:
    """doc_id, start (identifiers of all documents before it), n_tokens and, if asked for, tokens.

    The offsets of the partitions come from the small columns only; their table has a row per partition.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", *["tokens"] * tokens)


@tidy
def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("tokens")
        values, lengths = pc.list_flatten(tokens).to_numpy(zero_copy_only=False).astype("<u4"), pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        crc = [zlib.crc32(values[e - n:e]) for n, e in zip(lengths, ends)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the identifiers, read back from the files."""
    return read_tokens(spark, folder).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(df: DataFrame, tokenizer: str, end: int = 2, remembered: int = 60_000) -> DataFrame:
    """Write the token files of `df` to a new shared folder and return their index.

    `remembered` words, twice, are kept by each worker: more save time, about 200 bytes each.
    """
    folder = shared_folder(df.sparkSession)
    write_tokens(df, folder, tokenizer, end, remembered=remembered)
    return token_index(df.sparkSession, folder)
