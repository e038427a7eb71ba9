"""Line dedup with content-defined chunks.

The hashes of a document's lines roll over a window of lines; where the rolling hash is lower than at the
lines before and after, a chunk ends. Boundaries depend on a few neighbouring lines only, so an
inserted line shifts no later chunk, and every chunk has two lines or more. Chunks that occur more than once
in the corpus are kept at their first place and removed elsewhere. Equal hashes only nominate: chunks are
compared byte by byte. Then a removal grows line by line to both sides, as far as the lines beside it equal
those beside the place that stays.

DataFrame functions only. Hashes are counted first, combined before the shuffle, so that texts of chunks
travel only where the hash repeats; a very frequent chunk is one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from prefrank.llm.common import sent_if_small, written

#: Modulus of the rolling hash; line hashes have 28 bits, so products stay within 64.
MODULUS = (1 << 31) - 1
BASE = 1_000_003


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5; 0 for a line before the first."""
    return F.coalesce(F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long"), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def marked_chunks(text: Column) -> Column:
    """The text with "=" before each line and "#" before each chunk but the first; null for a text without lines.

    The hash rolls over two lines. A line where it is below the line before's and not above the next one's ends a
    chunk, unless a chunk of one line would be left at the text's start or end. So chunks have two lines or more
    and three on average. A line starts with "=" after
    every newline, so newline and "#" stand for a chunk's end only. Each line meets those before it by shifted
    copies of the list: nothing is looked up or computed again per line.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def marked(lines: Column) -> Column:
        hashes = F.transform(lines, line_hash)
        rolled = let(hashes, lambda h: F.zip_with(h, F.concat(F.array(zero), h), lambda one, two: (one * BASE + two) % MODULUS))
        ends = let(rolled, lambda r: F.zip_with(F.zip_with(F.concat(F.array(none), r), F.concat(F.array(none, none), r), lambda one, two: F.when(one < two, one)), r, lambda low, now: F.coalesce(low <= now, F.lit(False))))
        last = F.size(lines) - 2
        marks = F.transform(ends, lambda end, j: F.when(j == 0, "").when(end & (j >= 2) & (j <= last), "\n#").otherwise("\n"))
        return F.array_join(F.zip_with(lines, marks, lambda line, mark: F.concat(mark, F.lit("="), line)), "")

    return let(F.split(F.when(F.octet_length(text) > 0, text), "\n", -1), lambda lines: F.when(lines.isNotNull(), marked(lines)))


def line_count(chunk: Column) -> Column:
    return F.size(F.split(chunk, "\n", -1))


def equal_at_start(one: Column, two: Column) -> Column:
    """Number of leading elements in which two lists without nulls agree."""
    return F.array_position(F.concat(F.zip_with(one, two, lambda x, y: x.eqNullSafe(y)), F.array(F.lit(False))), False) - 1


def without_repeated_chunks(docs: DataFrame, least: int = 2) -> DataFrame:
    """`docs` with n_lines, n_removed (lines), n_chunks (removed) and kept (the remaining lines).

    `docs` needs doc_id and text; other columns stay, but those named like the new ones are replaced. A
    chunk of at least `least` lines that occurs more than once stays in the document of the smallest
    doc_id, at its first place there, and goes elsewhere. If one of its documents has a null doc_id it stays
    there instead. Rows with the same doc_id each keep the first place. In documents of other ids, lines of the
    chunk before or after a removed one go too, as far as they equal those at the place that stays (of several
    rows with its doc_id: the one of the smallest hash). Every removed line is left at some earlier place. A
    null or empty text has no lines and stays as it is; a text of any length is cut whole. An empty table gives
    no rows.
    """
    new = {"n_lines", "n_removed", "n_chunks", "kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    none = F.array(F.lit(None).cast("string"))
    cut = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.split(marked_chunks(F.col("text")), "\n#").alias("c"))
    own = cut.select("id", "h", F.posexplode(F.arrays_zip(F.col("c").alias("chunk"), F.concat(none, F.slice("c", 1, F.size("c") - 1)).alias("before"), F.concat(F.slice("c", 2, F.size("c")), none).alias("after"))).alias("place", "at"))
    own = own.select("id", "h", "place", "at.chunk", "at.before", "at.after")
    places = own.where(line_count(F.col("chunk")) >= least).withColumn("hash", F.xxhash64("chunk"))
    hashes = sent_if_small(written(places.groupBy("hash").count().where("count > 1").select("hash")))
    found = written(places.join(hashes, "hash"))
    # grouping by the chunk itself is the comparison of bytes; the counts and the first place combine before the shuffle
    stay = F.min(F.struct(F.col("id"), "h", "place", "before", "after"))
    repeats = found.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n"), stay.alias("s")).where("n > 1")
    repeats = written(repeats.select("hash", "chunk", F.monotonically_increasing_id().alias("chunk_id"), F.col("s.id").alias("first"), "s.before", "s.after"))
    known = sent_if_small(repeats.drop("before", "after"), F.octet_length("chunk"))
    each = found.select("id", "h", "place", "hash", "chunk").join(known, ["hash", "chunk"]).withColumn("here", F.col("id").eqNullSafe(F.col("first")))
    each = each.groupBy("id", "h", "chunk_id").agg(F.min(F.when(F.col("here"), F.col("place"))).alias("stays"), F.collect_set("place").alias("places"))
    each = each.withColumn("place", F.explode(F.filter("places", lambda p: F.col("stays").isNull() | (p != F.col("stays")))))
    gone = each.groupBy("id", "h").agg(F.collect_set("place").alias("__gone"), F.collect_set(F.when(F.col("stays").isNull(), F.struct("place", "chunk_id"))).alias("grow"))
    # only ends of removed runs grow; what stands beside the place that stays is fetched for them alone
    gone = written(gone.withColumn("grow", F.filter("grow", lambda g: ~(F.array_contains("__gone", g["place"] - 1) & F.array_contains("__gone", g["place"] + 1)))))
    beside = sent_if_small(repeats.select("chunk_id", "before", "after"), F.coalesce(F.octet_length("before"), F.lit(0)) + F.coalesce(F.octet_length("after"), F.lit(0)))
    edges = gone.select("id", "h", F.explode("grow").alias("g")).select("id", "h", "g.place", "g.chunk_id").join(beside, "chunk_id")
    edges = edges.groupBy("id", "h").agg(F.collect_set(F.struct("place", "before", "after")).alias("__edges"))
    gone = gone.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "__gone").join(edges, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("h")), "left").drop("id", "h")
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left")

    def side(i: Column, name: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter("__edges", lambda e: e["place"] == i), F.lit(1))[name], F.lit(""))

    def rest(chunk: Column, i: Column) -> Column:
        """A chunk's lines without those that go with its neighbours; null if it goes."""
        mine = F.split(chunk, "\n", -1)
        start = equal_at_start(mine, F.split(side(i - 1, "after"), "\n", -1))
        end = equal_at_start(F.reverse(mine), F.reverse(F.split(side(i + 1, "before"), "\n", -1)))
        left = F.slice(mine, (start + 1).cast("int"), F.greatest(F.size(mine) - start - end, F.lit(0)).cast("int"))
        beside = F.exists("__edges", lambda e: (e["place"] == i - 1) | (e["place"] == i + 1))
        return F.when(~F.array_contains("__gone", i), F.when(F.coalesce(beside, F.lit(False)), left).otherwise(mine))

    stay = F.flatten(F.filter(F.transform(F.split(marked_chunks(F.col("text")), "\n#"), rest), lambda c: c.isNotNull()))
    rows = rows.select(*names, F.when(F.octet_length("text") > 0, line_count(F.col("text"))).otherwise(0).cast("long").alias("n_lines"),
                       F.when(F.col("__gone").isNotNull(), F.size("__gone")).otherwise(0).cast("long").alias("n_chunks"), F.when(F.col("__gone").isNotNull(), stay).alias("__stay"))
    bare = F.array_join(F.transform("__stay", lambda line: F.substring(line, 2, 1 << 30)), "\n")
    return rows.select(*names, "n_lines", "n_chunks", F.when(F.col("__stay").isNull(), F.col("text")).otherwise(bare).alias("kept"),
                       F.when(F.col("__stay").isNull(), 0).otherwise(F.col("n_lines") - F.size("__stay")).cast("long").alias("n_removed"))
