"""Benchmark decontamination with a positional inverted index.

Terms are counted over all documents. Each different window of the benchmark is looked up by its rarest term,
so postings (document, position, neighbours) are stored for those few terms only. A posting whose neighbours
in the document are not the window's is dropped at once: that is the intersection with the posting lists
beside it, shifted by the offset of the term. What is left says where a window may start. There the
document's words, cut into segments that overlap by a window, are compared with the whole window, and what
occurs is merged to runs by item. A row holds at most one segment, however often a text repeats itself.

DataFrame functions only. Words are sent only of documents in which a window may begin, texts only if the table
of hits is too large to be sent to them; postings of common terms are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prefrank.llm.common import ascii_lower, sent_if_small, written


#: Words of a document that one row holds when windows are compared.
SEGMENT = 4096


def words(text: Column) -> Column:
    """Lower-case words (A-Z only are lowered): runs of digits, a-z and characters beyond ASCII; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """key, item_id, words of the items that have words; equal items once. Written, so that keys stay."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).dropDuplicates()
    return written(items.withColumn("key", F.monotonically_increasing_id()))


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """term, count: how often the items' terms occur in all documents. Counted in each task before the shuffle."""
    wanted = sent_if_small(written(items.select(F.explode("words").alias("term")).distinct()), F.octet_length("term"))
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").count()
    return seen.join(wanted, "term", "right").select("term", F.coalesce("count", F.lit(0)).alias("count"))


def distinct_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, phrase, size) of each different window, a shorter item being one, and (wid, item_id) of the items it is in."""
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("s")
    each = items.select("item_id", "words", starts).select("item_id", F.array_join(F.slice("words", F.col("s"), F.lit(window)), " ").alias("phrase")).distinct()
    found = written(each.select("phrase").distinct().select(F.monotonically_increasing_id().alias("wid"), "phrase", F.size(F.split("phrase", " ")).alias("size")))
    return found, written(each.join(found, "phrase").select("wid", "item_id"))


def rare_terms(docs: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """term, wid, place, before, after, size: each window's rarest term, its place there, and its neighbours inside."""
    counts = sent_if_small(written(term_counts(docs, items)), F.octet_length("term"))
    each = windows.select("wid", F.posexplode(F.split("phrase", " ")).alias("place", "term")).join(counts, "term")
    rarest = each.groupBy("wid").agg(F.min(F.struct("count", "place", "term")).alias("r")).where("r.count > 0")
    words_, at = F.split("phrase", " "), F.col("r.place")
    return rarest.join(windows, "wid").select(F.col("r.term").alias("term"), "wid", at.alias("place"), F.try_element_at(words_, F.when(at > 0, at)).alias("before"), F.try_element_at(words_, at + 2).alias("after"), "size")


def row_key() -> list[Column]:
    """A document's identity; rows equal in doc_id and text share it, and their results."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash")]


def postings(docs: DataFrame) -> DataFrame:
    """__id, __hash, position, term and the terms before and after, a row per word of each document."""
    w = F.col("words")
    zipped = F.arrays_zip(w.alias("term"), F.concat(F.array(F.lit("")), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).alias("left"), F.concat(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), F.array(F.lit(""))).alias("right"))
    return (docs.select(*row_key(), words(F.col("text")).alias("words")).where(F.size("words") > 0)
            .select("__id", "__hash", F.posexplode(zipped).alias("position", "w")).select("__id", "__hash", "position", "w.term", "w.left", "w.right"))


def stored_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the given terms, written: the inverted index that phrase look-ups read."""
    return written(postings(docs).join(sent_if_small(terms.select("term").distinct(), F.octet_length("term")), "term", "left_semi"))


def candidates(docs: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """__id, __hash, segment, starts (wid, start, size): where windows may begin, by segment of the document."""
    terms = written(rare_terms(docs, items, windows))
    index = stored_postings(docs, terms)
    same = lambda own, theirs: F.col(theirs).isNull() | (F.col(own) == F.col(theirs))
    start = F.col("position") - F.col("place")
    found = index.join(sent_if_small(terms, F.octet_length("term") * 3), "term").where(same("left", "before") & same("right", "after") & (start >= 0))
    found = found.select("__id", "__hash", "wid", start.alias("start"), "size").distinct()
    return found.groupBy("__id", "__hash", F.floor(F.col("start") / SEGMENT).cast("int").alias("segment")).agg(F.collect_list(F.struct("wid", "start", "size")).alias("starts"))


def occurrences(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """__id, __hash, item_id, start, size: the windows that occur, compared with the document's words."""
    windows, links = distinct_windows(items, window)
    places = written(candidates(docs, items, windows)).withColumnsRenamed({"__id": "__i", "__hash": "__h", "segment": "__s"})
    near = sent_if_small(places.select("__i", "__h").distinct())
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))
    # Only documents in which a window may begin are cut and sent.
    own = docs.select(*row_key(), "text").join(near, same, "left_semi").select("__id", "__hash", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cuts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / SEGMENT).cast("int"))
    segments = own.select("__id", "__hash", "words", F.explode(cuts).alias("segment")).select(
        "__id", "__hash", "segment", F.slice("words", F.col("segment") * SEGMENT + 1, F.lit(SEGMENT + window - 1)).alias("words"))
    on = same & (F.col("segment") == F.col("__s"))
    phrase = lambda p: F.array_join(F.slice("words", p["start"] - F.col("segment") * SEGMENT + 1, p["size"]), " ")
    seen = segments.join(places, on).select("__id", "__hash", F.explode(F.transform("starts", lambda p: F.struct(p["wid"].alias("wid"), p["start"].alias("start"), p["size"].alias("size"), phrase(p).alias("phrase")))).alias("w"))
    known = sent_if_small(windows.select("wid", "phrase"), F.octet_length("phrase"))
    return seen.select("__id", "__hash", "w.*").join(known, ["wid", "phrase"]).join(sent_if_small(links), "wid").select("__id", "__hash", "item_id", "start", "size")


def merged_runs(found: DataFrame) -> DataFrame:
    """__id, __hash, item_id, at, size: maximal runs of words inside the item's occurring windows."""
    ahead = W.partitionBy("__id", "__hash", "item_id").orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(ahead.rowsBetween(W.unboundedPreceding, -1))
    opened = found.distinct().withColumn("__new", F.when(F.col("start") <= before, 0).otherwise(1))
    runs = opened.withColumn("__run", F.sum("__new").over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("__id", "__hash", "item_id", "__run").agg(F.min("start").alias("at"), F.max(F.col("start") + F.col("size")).alias("end")).select("__id", "__hash", "item_id", "at", (F.col("end") - F.col("at")).alias("size"))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, contaminated, and hits (item_id, at, size).

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns of `docs` stay, but those
    named like the new ones are replaced. A window is `window` consecutive words of an item, or a whole
    shorter item; hits are the maximal runs of words inside an item's windows. Null or empty texts have no
    words and no hits; items without words never occur. Very long and repetitive texts are handled in
    segments. A null doc_id is an ordinary id. Items with a null id mark words but are not listed. An
    item_id with several texts counts once. Repeated rows are all kept. Empty tables give no rows, or no hits.
    """
    new = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    runs = merged_runs(occurrences(docs.select("doc_id", "text"), benchmark_items(benchmark), window))
    end = F.col("at") + F.col("size")
    before = F.max(end).over(W.partitionBy("__id", "__hash").orderBy("at", "size", "item_id").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("__own", F.greatest(end - F.greatest("at", F.coalesce(before, F.lit(0))), F.lit(0)))
    found = runs.groupBy("__id", "__hash").agg(F.sum("__own").alias("__hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("__items"), F.collect_list(F.struct("item_id", "at", "size")).alias("__runs"))
    found = sent_if_small(written(found), F.octet_length(F.array_join("__items", "")) + 16 * F.size("__items") + 32 * F.size("__runs"))
    rows = docs.withColumn("n_words", F.size(words(F.col("text"))).cast("long")).withColumn("__own", F.xxhash64("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    rows = rows.withColumn("n_hit", F.coalesce("__hit", F.lit(0)).cast("long")).withColumn("__items", F.coalesce("__items", F.array().cast("array<string>")))
    return (rows.withColumn("n_items", F.size("__items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("__items", ","), 256))
            .withColumn("contaminated", F.col("n_hit") > 0).withColumn("hits", F.coalesce("__runs", F.array())).drop("__id", "__hash", "__own", "__hit", "__items", "__runs"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = 8) -> DataFrame:
    """doc_id, item_id, distance: documents where an item's two rarest different terms come within `within` words.

    Distance is the smallest between any two of their positions. Only terms that occur in the documents
    are ranked; items with fewer than two such terms are left out. Nulls as in `marked`.
    """
    items = benchmark_items(benchmark)
    each = items.select("key", "item_id", F.explode(F.array_distinct("words")).alias("term")).join(term_counts(docs, items).where("count > 0"), "term")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("count", "term"))).where("rank <= 2")
    pairs = written(ranked.select("key", "item_id", "term", "rank"))
    places = stored_postings(docs, pairs).select("__id", "__hash", "position", "term").distinct().join(sent_if_small(pairs, F.octet_length("term")), "term")
    back = W.partitionBy("__id", "__hash", "key", "item_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.col("rank") == 1, F.max(F.when(F.col("rank") == 2, F.col("position"))).over(back)).otherwise(F.max(F.when(F.col("rank") == 1, F.col("position"))).over(back))
    near = places.withColumn("distance", F.col("position") - last).where(F.col("distance") <= within)
    return near.groupBy(F.col("__id").alias("doc_id"), "__hash", "key", "item_id").agg(F.min("distance").alias("distance")).select("doc_id", "item_id", "distance")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Rows of `docs` without a hit; its columns only."""
    hit = sent_if_small(written(occurrences(docs.select("doc_id", "text"), benchmark_items(benchmark), window).select("__id", "__hash").distinct()))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    back = {c: f"__c{i}" for i, c in enumerate(others)}
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(back[c]) for c in others], F.xxhash64("text").alias("__own"))
    clean = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_anti")
    return clean.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])
