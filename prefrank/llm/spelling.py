"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

The vocabulary is cut into blocks of words that share their first or their last half, as one error leaves
one half of the shorter word unchanged. Inside a block the words are columns of bit-sliced index: for each
(position, letter) a bitset of the words that have this letter there, and for each length a bitset. A word is
looked up by running over its letters and keeping four bitsets at once, all words of the block in parallel:
those equal so far, and those with one replaced letter (same position), one letter of the looked-up word
left out (position shifted down) and one letter more (position shifted up). Bitsets are integers, so a step
is a few word-parallel operations.

A pair that shares both halves counts in the block of the first one only. Large blocks are cut into chunks
that meet two by two, and each task hands on one row a word: how many near words, and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prefrank.llm.common import LOWER, UPPER, pieces, sent_if_small, tidy, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def altered(doc_id: str, run: str, every: int) -> str:
    """`run` without the letter that a hash of document and run picks, in one of `every` cases."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % every == 0 else run


@tidy
def word_counts(batches: Iterator[pa.RecordBatch], shortest: int, every: int, held: int) -> Iterator[pa.RecordBatch]:
    """word, n: counts of a task, handed on whenever it holds `held` words or letters in proportion."""
    counts: Counter[str] = Counter()
    letters = 0

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for b in pieces(batches, 64):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            prefix = f"{'null' if doc_id is None else doc_id}"
            start = zlib.crc32(f"{prefix}:".encode())
            for run, n in Counter(RUN.findall((text or "").translate(ASCII_LOWER))).items():
                if len(run) >= shortest:
                    if zlib.crc32(run.encode(), start) % every == 0:
                        run = altered(prefix, run, every)
                        if len(run) < shortest:
                            continue
                    counts[run] += n
                    letters += len(run)
            if len(counts) >= held or letters > 64 * held:
                yield part()
                counts.clear()
                letters = 0
    if counts:
        yield part()


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, held: int = 200_000) -> DataFrame:
    """word, n: distinct altered runs of letters with at least `shortest` code points and `least` occurrences."""
    docs = docs.select("doc_id", "text")
    parts = docs.mapInArrow(lambda b: word_counts(b, shortest, every, held), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class BitSlices:
    """Index of a block's words: bitsets by (position, letter) and by length. Bit k stands for word k."""

    def __init__(self, words: list[str]):
        self.at: dict[tuple[int, str], int] = {}
        self.lengths: dict[int, int] = {}
        slots: dict[tuple[int, str], list[int]] = {}
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
            for slot in enumerate(w):
                slots.setdefault(slot, []).append(k)
        size = len(words) // 8 + 1
        for target, lists in ((self.at, slots), (self.lengths, by_length)):
            for slot, ks in lists.items():
                bits = bytearray(size)
                for k in ks:
                    bits[k >> 3] |= 1 << (k & 7)
                target[slot] = int.from_bytes(bits, "little")
        self.all = (1 << len(words)) - 1

    def near(self, word: str) -> int:
        """Words at exactly one insertion, deletion or replacement."""
        at, n = self.at.get, len(word)
        same, replaced, fewer, more = self.all, 0, 0, 0
        for i, letter in enumerate(word):
            here, above = at((i, letter), 0), at((i + 1, letter), 0)
            # from the sets before this letter: it is left out (fewer), replaced, or comes after one letter more
            fewer, more, replaced, same = (fewer & at((i - 1, letter), 0)) | same, (more | same) & above, (replaced & here) | (same & ~here), same & here
            if not (same | replaced | fewer | more):
                return 0
        has = self.lengths.get
        return (replaced & has(n, 0)) | (fewer & has(n - 1, 0)) | ((more | same) & has(n + 1, 0))


def block_keys(word: Column, n: Column) -> Column:
    """(half, length of the shorter word, shared half) of the blocks a word belongs to.

    A pair's shorter word has length m; without its error the first m / 2 letters (rounded down) or the last
    m - m / 2 stay the same. A word meets those of its own length, and is the shorter or the longer one of others.
    """
    def key(half: int, m: Column) -> Column:
        cut = F.floor(m / 2).cast("int")
        part = F.substring(word, F.lit(1), cut) if half == 0 else F.right(word, m - cut)
        return F.struct(F.lit(half).alias("half"), m.cast("int").alias("m"), part.alias("part"))

    return F.array(*[key(half, m) for half in (0, 1) for m in (n, n - 1)])


def best(n: int, word: str) -> tuple[int, str]:
    return (-n, word)


@tidy
def tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, near_n, near: near words of each word in its tile, how many and the most frequent.

    Rows of a tile (half, m, part, i, j) follow each other; chunk i is looked up in chunk j and the other way round.
    """
    key, members = None, []

    def looked_up() -> tuple[list, list, list, list]:
        half, m, _, i, j = key
        cut = m // 2
        out: tuple[list, list, list, list] = ([], [], [], [])
        sides = [(i, j)] if i == j else [(i, j), (j, i)]
        for one, two in sides:
            asked = [(w, n) for w, n, c in members if c == one]
            kept = [(w, n) for w, n, c in members if c == two]
            index = BitSlices([w for w, _ in kept])
            for w, n in asked:
                found, count, top = index.near(w), 0, None
                while found:
                    low = found & -found
                    found ^= low
                    other, times = kept[low.bit_length() - 1]
                    # a pair belongs to the length of its shorter word, and to its first half if that is shared
                    if min(len(w), len(other)) != m or (half and w[:cut] == other[:cut]):
                        continue
                    count += 1
                    if top is None or best(times, other) < best(*top):
                        top = (times, other)
                if count:
                    for column, value in zip(out, (w, count, top[0], top[1])):
                        column.append(value)
        return out

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(looked_up(), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("half", "m", "part", "i", "j", "word", "n", "chunk")]):
            if row[:5] != key:
                if len(members) > 1:
                    yield made()
                key, members = row[:5], []
            members.append(row[5:])
    if len(members) > 1:
        yield made()


def near_words(words: DataFrame, chunk_words: int = 4096, chunk_letters: int = 1 << 20) -> DataFrame:
    """word, n_near, near_n, near of every word of `words` (word, n; distinct) that has near words.

    near is the near word of largest n, the smallest in code-point order among equals.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.char_length("word")
    own = words.select("word", "n", F.explode(block_keys(F.col("word"), size)).alias("b")).select("b.*", "word", "n")
    sizes = own.groupBy("half", "m", "part").agg(F.count(F.lit(1)).alias("words"), F.sum(size).alias("letters")).where("words > 1")
    large = sizes.select("half", "m", "part", F.ceil(F.greatest(F.col("words") / chunk_words, F.col("letters") / chunk_letters)).cast("int").alias("chunks")).where("chunks > 1")
    large = sent_if_small(written(large), F.octet_length("part"))
    cut = own.join(large, ["half", "m", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = cut.select("half", "m", "part", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "word", "n", "chunk")
    keys = ["half", "m", "part", "i", "j"]
    found = tiles.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tile_rows, "word string, n_near long, near_n long, near string")
    # strings compare by their UTF-8 bytes, which is code-point order
    top = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.order")).alias("near_n"), F.col("top.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following `forms` (word, form) ends. The way known so far doubles in each round.

    n grows at least tenfold along a form, so ways have at most 19 steps and five rounds are enough.
    """
    ways = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        onward = sent_if_small(ways.select(F.col("word").alias("root"), F.col("root").alias("next")), F.octet_length("root") + F.octet_length("next"))
        longer = written(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return ways


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of `docs` (doc_id, text; other columns are left out).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one of `every` with a letter taken
    out as a hash of document and run says; at least `shortest` code points and `least` occurrences. Every row
    counts, repeated rows too. form is the near word of largest n (ties: first in code-point order) if that n is
    at least `times` the word's, else null; root is where forms lead from the word. Null and empty texts have no
    words; a null doc_id is hashed as "null". Texts and runs of any length count whole. An empty table, or one
    without words, gives no rows.
    """
    words = written(vocabulary(docs, shortest, least, every))
    near = near_words(words)
    known = words.join(near, "word", "left")
    has_form = F.col("near_n") >= times * F.col("n")
    rows = written(known.select("word", F.when(has_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("near_n")).alias("form_n")))
    ends = sent_if_small(roots(rows.where("form IS NOT NULL")), F.octet_length("word") + F.octet_length("root"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
