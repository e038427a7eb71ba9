"""Source and sink queries: given tables are written in a format to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefrank.plans.registry import query
from prefrank.sources import tables as S
from prefrank.streaming import incremental as I


@query("s1_csv_scan", oracle="SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(t):
    path = S.scratch_folder(t.spark)
    S.write_csv(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return S.read_csv(t.spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query("s2_csv_projection", oracle="SELECT p_partkey, p_size FROM part")
def _(t):
    path = S.scratch_folder(t.spark)
    S.write_csv(t.part.select("p_partkey", "p_name", "p_size"), path)
    return S.read_csv(t.spark, path, "p_partkey bigint, p_name string, p_size int", ["p_partkey", "p_size"])


@query("s3_tsv_list_columns", oracle="""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(p_name, '+', p_type) END AS names FROM part""")
def _(t):
    path = S.scratch_folder(t.spark)
    lists = F.when(F.col("p_size") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_type", F.lit("']")))
    t.part.select("p_partkey", lists.alias("names")).write.csv(path, header=True, sep="\t", quote="")
    d = S.read_tsv_lists(t.spark, path, "p_partkey bigint, names string", ["names"])
    return d.select("p_partkey", F.array_join("names", "+").alias("names"))


@query("s4_parquet_scan", oracle="SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t.lineitem.select("l_orderkey", "l_quantity").filter("l_quantity > 45")


@query("s6_version_detection", oracle="SELECT 'parquet' AS version, count(*) AS n FROM part")
def _(t):
    path = S.scratch_folder(t.spark)
    t.part.select("p_partkey").write.parquet(f"{path}/attestations.parquet")
    return t.spark.read.parquet(f"{path}/attestations.parquet").agg(
        F.lit(S.detect_version(t.spark, path)).alias("version"), F.count(F.lit(1)).alias("n"))


@query("s7_target_spelling", uses="oof", oracle="SELECT category, item, true_score, predicted_score FROM oof")
def _(t):
    path = S.scratch_folder(t.spark)
    S.write_csv(t.oof.withColumnRenamed("true_score", "true_rank"), path)
    return S.read_oof(t.spark, path, "category string, item bigint, true_rank double, predicted_score double").drop("model")


@query("s8_model_files", uses="oof_multi", oracle="SELECT model, category, item, true_score, predicted_score FROM oof_multi")
def _(t):
    path = S.scratch_folder(t.spark)
    for m in ("price", "discount", "tax"):
        S.write_csv(t.oof_multi.filter(F.col("model") == m).drop("model"), f"{path}/{m}.csv")
    d = S.read_oof(t.spark, path, "category string, item bigint, true_score double, predicted_score double")
    return d.select("model", "category", "item", "true_score", "predicted_score")


@query("s9_probability_sink", uses="probs", oracle="SELECT id, y_true, round(p0, 9) AS prob_x, round(p1, 9) AS prob_y FROM probs")
def _(t):
    path = S.scratch_folder(t.spark)
    S.write_probabilities(t.probs.select("id", "y_true", F.array("p0", "p1").alias("probs")), path, ["x", "y"])
    return t.spark.read.parquet(path).select("id", "y_true", F.round("prob_x", 9).alias("prob_x"), F.round("prob_y", 9).alias("prob_y"))


@query("s10_exact_csv_sink", oracle="SELECT event_id, value / 3 AS third FROM events")
def _(t):
    path = S.scratch_folder(t.spark)
    S.write_csv(t.events.select("event_id", (F.col("value") / 3).alias("third")), path)
    return S.read_csv(t.spark, path, "event_id bigint, third double")


@query("s11_incremental_cache", oracle="SELECT p_partkey, p_partkey * 2 AS twice, p_partkey % 3 = 0 AS first_run FROM part")
def _(t):
    path = S.scratch_folder(t.spark)
    run = lambda first: lambda d: d.withColumn("twice", F.col("p_partkey") * 2).withColumn("first_run", F.lit(first))
    I.append_missing(t.spark, t.part.filter("p_partkey % 3 = 0"), path, ["p_partkey"], run(True))
    return I.append_missing(t.spark, t.part, path, ["p_partkey"], run(False))


@query("s12_resume_log", uses="judgements", oracle="""
    SELECT concat_ws(':', category, item_1, item_2) AS test_id, CASE WHEN status = 'PARSE_FAIL' THEN 'RETRIED' ELSE status END AS status FROM judgements""")
def _(t):
    log = t.judgements.select(F.concat_ws(":", "category", "item_1", "item_2").alias("test_id"), "status")
    return I.resumed_log(log, log.select("test_id"), lambda d: d.withColumn("status", F.lit("RETRIED")))


@query("s13_fingerprinted_slice", oracle="SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t):
    path = S.scratch_folder(t.spark)
    build = lambda: t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    S.cached_table(t.spark, path, "abc", build)
    return S.cached_table(t.spark, path, "abc", lambda: t.part.limit(0).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")))
