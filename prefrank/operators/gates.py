"""Data-quality gates: each returns its findings as a table; `enforce` raises if there are any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from prefrank.functions.hashing import hash32


class GateError(ValueError):
    """A gate found rows that must not exist."""


def enforce(findings: DataFrame, what: str) -> None:
    bad = findings.limit(5).collect()
    if bad:
        raise GateError(f"{what}: {[r.asDict() for r in bad]}")


def leakage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both splits."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """O3: rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def build_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Keys of one build only, and the largest absolute difference over the shared vectors."""
    d = a.select(*keys, F.col(vec).alias("_a")).join(b.select(*keys, F.col(vec).alias("_b")), list(keys), "full_outer")
    diff = F.array_max(F.transform(F.zip_with("_a", "_b", lambda x, y: x - y), lambda x: F.abs(x)))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return d.agg(n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"), F.max(diff).alias("max_abs_diff"))


def class_drift(df: DataFrame, label: str, expected: Mapping[object, int], tolerance: int) -> DataFrame:
    """Classes whose count is off by more than the tolerance, or on one side only."""
    want = df.sparkSession.createDataFrame([(str(k), int(v)) for k, v in expected.items()], "label string, expected long")
    got = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    d = got.join(F.broadcast(want), ["label"], "full_outer")
    off = F.col("n").isNull() | F.col("expected").isNull() | (F.abs(F.col("n") - F.col("expected")) > tolerance)
    return d.filter(off)


def output_contract(train: DataFrame, test: DataFrame, solution: DataFrame, label: str, levels: Sequence[str]) -> DataFrame:
    """One row per check with the number of violations."""
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    parts = [
        count(train.select("id").join(test.select("id"), ["id"], "left_semi"), "ids_shared"),
        count(set_difference(test.select("id"), solution.select("id")), "test_and_solution_ids_differ"),
        count(solution.filter(~F.col(label).isin(list(levels)) | F.col(label).isNull()), "unknown_labels"),
        count(test.limit(1) if label in test.columns else test.limit(0), "label_in_test"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def golden_values(measured: DataFrame, expected: Mapping[str, float], tolerance: float) -> DataFrame:
    """Published values that were not reproduced; `measured` has name and value."""
    want = measured.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "name string, expected double")
    d = F.broadcast(want).join(measured, ["name"], "left")
    return d.filter(F.col("value").isNull() | (F.abs(F.col("value") - F.col("expected")) > tolerance))


def failure_rate(df: DataFrame, failed: str, limit: float = 0.01) -> DataFrame:
    """One row with the share of failures if it is above the limit."""
    return df.agg(F.avg(F.when(F.col(failed), 1.0).otherwise(0.0)).alias("rate")).filter(F.col("rate") > limit)


def unmatched_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K7: one row if no key of the left side exists on the right."""
    hit = left.select(*keys).join(right.select(*keys).distinct(), list(keys), "left_semi").limit(1)
    return hit.agg(F.count(F.lit(1)).alias("matches")).filter("matches = 0")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-independent hash of all columns."""
    h = hash32(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h).cast("decimal(38,0)").cast("string").alias("sum_hash"))
