"""Readers and writers of the tables the operators work on."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prefrank.session import ensure_checkpoint_dir

RATINGS = "category string, respondent bigint, item bigint, similarity double, year int"
OOF = "category string, item bigint, true_score double, predicted_score double"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; executors of a cluster all see it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None,
             sep: str = ",") -> DataFrame:
    """CSV with a header and a given schema; only the chosen columns are parsed."""
    d = spark.read.schema(schema).csv(path, header=True, sep=sep, enforceSchema=False)
    return d.select(*columns) if columns else d


def read_tsv_lists(spark: SparkSession, path: str, schema: str, list_cols: Sequence[str]) -> DataFrame:
    """S3: TSV whose list columns are written as quoted Python lists: ['a', 'b']."""
    d = spark.read.schema(schema).csv(path, header=True, sep="\t", quote="", enforceSchema=False)
    for c in list_cols:
        json = F.regexp_replace(F.col(c), r"(?<=[\[,\s])'|'(?=[\],])", '"')
        d = d.withColumn(c, F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")))
    return d


def detect_version(spark: SparkSession, folder: str) -> str:
    """The newer release ships one evidence table as parquet, the older one TSV lists."""
    for version, name in (("parquet", "attestations.parquet"), ("tsv", "contains.tsv")):
        if path_exists(spark, f"{folder}/{name}"):
            return version
    raise FileNotFoundError(f"no known knowledge-graph release in {folder}")


def normalised_target(df: DataFrame) -> DataFrame:
    """`true_rank` is read as `true_score`; nothing to do if neither or the latter is there."""
    if "true_rank" in df.columns and "true_score" not in df.columns:
        return df.withColumnRenamed("true_rank", "true_score")
    return df


def read_oof(spark: SparkSession, paths: str | Sequence[str], columns: str) -> DataFrame:
    """Prediction files with their file name (without ending) as `model`."""
    d = spark.read.schema(columns).csv(paths, header=True, recursiveFileLookup=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return normalised_target(d.withColumn("model", F.regexp_replace(folder, r"\.csv$", "")))


def write_probabilities(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One column per class."""
    df.select("id", "y_true", *[F.col("probs")[i].alias(f"prob_{n}") for i, n in enumerate(order)]).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV; doubles are written with the shortest text that reads back to the same value."""
    df.write.mode("overwrite").csv(path, header=True)


def cached_table(spark: SparkSession, path: str, config: str, build) -> DataFrame:
    """Reuse a table written under the same configuration fingerprint, else build and write it."""
    target = f"{path}/config={config}"
    try:
        if path_exists(spark, f"{target}/_SUCCESS"):
            return spark.read.parquet(target)
    except AnalysisException:
        pass  # a folder without data is built again
    build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
