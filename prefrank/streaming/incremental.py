"""Incremental runs over append-only tables: only what is missing or failed is processed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from prefrank.sources.tables import path_exists

FINAL_STATUS = ("OK", "NO_DATA", "OUT_OF_SCOPE")


def missing_keys(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted keys that the cache does not hold yet."""
    return wanted.select(*keys).distinct().join(done.select(*keys), list(keys), "left_anti")


def append_missing(spark: SparkSession, wanted: DataFrame, path: str, keys: Sequence[str],
                   process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process the missing keys, append them to the table, and read it whole."""
    todo = wanted.select(*keys).distinct()
    if path_exists(spark, f"{path}/_SUCCESS"):
        todo = missing_keys(wanted, spark.read.parquet(path), keys)
    process(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def resumed_log(log: DataFrame, wanted: DataFrame, retry: Callable[[DataFrame], DataFrame], key: str = "test_id",
                final: Sequence[str] = FINAL_STATUS) -> DataFrame:
    """Keep finished rows, retry every other wanted key, merge in key order."""
    kept = log.filter(F.col("status").isin(list(final)))
    todo = wanted.join(kept.select(key), [key], "left_anti")
    return kept.unionByName(retry(todo)).orderBy(key)
