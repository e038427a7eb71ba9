"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from prefrank.llm import binary, decontaminate, jaccard, lines, minhash, mixing, neighbours, quality, spelling, suffix, tokens, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op4_token_files")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return binary.tokenize(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), remembered=200_000)


@query("op10_source_mix")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op9_quality_score")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs.withColumn("held_out", quality.held_out()), model).select("doc_id", "held_out", "score", "predicted")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op6_url_filter")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"), RULES, model).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
             AND len([x FOR x IN embedding IF x <> 0]) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.e, c.e)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e) GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


@query("op5_nearest_vectors", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors.where("vec_id % 100 = 0"), vectors)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw USING (win)),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""


@query("op8_benchmark_hits", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.marked(docs, table(spark, folder, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_shingle_components")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(table(spark, folder, "documents"), shingle=4, percent=85)


@query("op7_repeated_bytes")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.without_repeats(table(spark, folder, "documents")).drop("kept")


#: As the operator: windows of 2 lines, chunks of 2 lines or more, grown into the chunks beside them.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN strlen(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS lines FROM documents),
l AS (SELECT r, i, list_extract(lines, i) AS line, len(lines) AS n, CAST('0x' || substr(md5(list_extract(lines, i)), 1, 7) AS BIGINT) AS h FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT *, (h * 1000003 + coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), 0)) % 2147483647 AS v FROM l),
e AS (SELECT *, i = n OR (v < lag(v) OVER (PARTITION BY r ORDER BY i) AND v <= lead(v) OVER (PARTITION BY r ORDER BY i) AND i <= n - 2) AS ends FROM k),
p AS (SELECT *, coalesce(sum(CAST(coalesce(ends, false) AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM e),
c AS (SELECT r, piece, list(line ORDER BY i) AS chunk FROM p GROUP BY ALL),
n AS (SELECT c.*, doc_id, lag(chunk) OVER w AS before, lead(chunk) OVER w AS after FROM c JOIN d USING (r) WINDOW w AS (PARTITION BY r ORDER BY piece)),
s AS (SELECT chunk, count(*) AS times, min(doc_id) AS first, arg_min(before, (doc_id, piece)) AS sb, arg_min(after, (doc_id, piece)) AS sa FROM n WHERE len(chunk) >= 2 GROUP BY chunk),
g AS (SELECT n.*, times > 1 AND NOT (doc_id = first AND row_number() OVER (PARTITION BY r, n.chunk ORDER BY piece) = 1) AS goes, times > 1 AND doc_id <> first AS grows, sb, sa
      FROM n LEFT JOIN s ON s.chunk = n.chunk AND len(n.chunk) >= 2),
x AS (SELECT *, CASE WHEN lag(grows) OVER w THEN lag(sa) OVER w END AS pa, CASE WHEN lead(grows) OVER w THEN lead(sb) OVER w END AS nb FROM g WINDOW w AS (PARTITION BY r ORDER BY piece)),
y AS (SELECT *, CASE WHEN pa IS NULL THEN 0 ELSE len([z FOR z IN range(1, least(len(chunk), len(pa)) + 1) IF chunk[1:z] = pa[1:z]]) END AS start,
             CASE WHEN nb IS NULL THEN 0 ELSE len([z FOR z IN range(1, least(len(chunk), len(nb)) + 1) IF chunk[len(chunk) - z + 1:] = nb[len(nb) - z + 1:]]) END AS stop FROM x),
t AS (SELECT r, count(*) FILTER (WHERE goes) AS n_chunks, flatten(list(chunk[start + 1:len(chunk) - stop] ORDER BY piece) FILTER (WHERE goes IS NOT TRUE)) AS rest FROM y GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(len(rest), 0) AS BIGINT) AS n_removed, coalesce(n_chunks, 0) AS n_chunks, sha256(coalesce(array_to_string(rest, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.without_repeated_chunks(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("op12_whitened_vectors")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.train(vectors)).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query("op13_minhash_duplicates")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)
