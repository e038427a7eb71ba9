"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a reproducible shuffled order. A document's virtual start and finish are
the words of its source before and after it, divided by the source's target; a second round follows the
first where a target exceeds its source. All sources are served in order of virtual finish until the
budget is spent, so each gets words in proportion to its target all along.

Running sums never need a source, or the corpus, in one task: a source is cut into cells by the leading
bits of the shuffle hash, the global order into cells of virtual time. Sums run inside cells, and a small
table of cell totals links them. Cells are even whatever the sizes of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefrank.llm.common import written

CELLS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of sources (key, source, source_size): `share` of all words by weight, at most `most` times the size.

    Weights go round the sources in code point order, null last. With sources ordered by cap / weight, the
    capped ones come first; the level of the others is what is left over their weights. One row per source.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "key")
    whole = W.partitionBy(F.lit(0))
    return (sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
            .withColumn("budget", share * F.sum("source_size").over(whole))
            .withColumn("level", (F.col("budget") - (F.sum("cap").over(by_cap) - F.col("cap"))) / (F.sum("weight").over(whole) - F.sum("weight").over(by_cap) + F.col("weight")))
            .withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("key"), F.col("level")))).over(whole)["level"])
            .select("key", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"), "budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target (both of the source) and taken (words the mix takes, repeats counted).

    Needs doc_id, text, source; other columns are left out. Null or empty texts have size 0 and are never
    taken. A null source is a source of its own, last in order. A null doc_id is an ordinary id. Rows that
    repeat count each; equal rows may stand for each other. A source leaves the queue when its virtual
    time passes 1, so it misses its target by less than a document. An empty table gives no rows.
    """
    return queued(docs, weights, share, most).drop("h")


def row_hash() -> Column:
    """Shuffle order of a document, and its identity up to rows equal in doc_id and text."""
    return F.xxhash64("doc_id", "text")


def queued(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """`mix` with the shuffle hash h of each row."""
    sized = written(docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("key"), word_count(F.col("text")).alias("size"), row_hash().alias("h"))
                    .withColumn("cell", F.shiftrightunsigned("h", 64 - (CELLS - 1).bit_length()).cast("int")))
    cells = sized.groupBy("key", "cell").agg(F.sum("size").alias("cell_size"))
    sources = cells.groupBy("key").agg(F.sum("cell_size").alias("source_size")).withColumn("source", F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)))
    targets = source_targets(sources, weights, share, most)
    before = F.sum("cell_size").over(W.partitionBy("key").orderBy("cell")) - F.col("cell_size")
    cells = cells.withColumn("before", before).join(targets, "key")
    in_cell = W.partitionBy("key", "cell").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = sized.withColumn("at", F.sum("size").over(in_cell) - F.col("size")).join(cells, ["key", "cell"])

    def start(turn: Column) -> Column:
        return F.when(F.col("size") > 0, (turn * F.col("source_size") + F.col("before") + F.col("at")) / F.col("target"))

    def tag(turn: Column) -> Column:
        """Place in the global order: virtual finish, then the shuffle hash."""
        finish = start(turn) + F.col("size") / F.col("target")
        return F.struct(finish.alias("finish"), F.col("h"), F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("size"), turn.alias("turn"))

    rows = written(rows.select("doc_id", "h", "size", "source_size", "target", "budget", F.array(*[F.when(start(F.lit(i)) < 1, tag(F.lit(i))) for i in range(most)]).alias("tags")))
    queue = rows.select("budget", F.explode("tags").alias("tag")).where(F.col("tag").isNotNull()).withColumn("slot", F.least(F.floor(F.col("tag.finish") * CELLS), F.lit(CELLS)).cast("int"))
    slots = queue.groupBy("slot").agg(F.sum("tag.size").alias("slot_size"))
    slots = slots.select("slot", (F.sum("slot_size").over(W.orderBy("slot")) - F.col("slot_size")).alias("slot_before"))
    in_slot = W.partitionBy("slot").orderBy("tag").rowsBetween(W.unboundedPreceding, 0)
    ahead = F.col("slot_before") + F.sum("tag.size").over(in_slot) - F.col("tag.size")
    last = queue.join(F.broadcast(slots), "slot").withColumn("ahead", ahead).where(F.col("ahead") + F.col("tag.size") / 2 <= F.col("budget")).agg(F.max("tag").alias("last"))
    taken = F.aggregate("tags", F.lit(0).cast("long"), lambda n, t: n + F.when(t <= F.col("last"), F.col("size")).otherwise(F.lit(0)))
    return rows.join(F.broadcast(last), F.lit(True), "left").select("doc_id", "h", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken. Columns of `docs` only.

    Rows equal in doc_id and text share evenly what the mix takes of them.
    """
    parts = (queued(docs, **settings).where("taken > 0").groupBy("h")
             .agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias("__turns")).withColumnRenamed("h", "__taken"))
    numbered = docs.withColumn("__h", row_hash()).withColumn("__of", F.count(F.lit(1)).over(W.partitionBy("__h"))).withColumn("__row", F.row_number().over(W.partitionBy("__h").orderBy("__h")))
    own = F.floor(F.col("__turns") / F.col("__of")) + (F.col("__row") <= F.col("__turns") % F.col("__of")).cast("long")
    return (numbered.join(parts, F.col("__h") == F.col("__taken")).withColumn("__own", own).where("__own > 0")
            .withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own")))).select(*[F.col(f"`{c}`") for c in docs.columns]))
