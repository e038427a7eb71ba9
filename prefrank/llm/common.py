"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

T = TypeVar("T")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Only a session on a single machine may lack that setting; it gets a folder below /tmp, once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: later reads see the same rows and no lineage."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return free memory of this worker to the system: workers are used again, and keep what they took otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not in every C library
        pass


def tidy(make: Callable[..., Iterator[T]]) -> Callable[..., Iterator[T]]:
    """A generator function whose worker gives memory back when a task has taken its last batch."""

    @wraps(make)
    def run(*args, **kwargs) -> Iterator[T]:
        try:
            yield from make(*args, **kwargs)
        finally:
            give_back()

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does the same on ASCII texts and is quicker there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Most bytes of a table sent to every executor; counted before.
BROADCAST_BYTES = 16 << 20


def sent_if_small(df: DataFrame, width: Column | int = 0, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted bytes (`width` and 64 a row) are at most `most`; otherwise joins shuffle it."""
    size = df.agg(F.sum((F.lit(width) if isinstance(width, int) else width) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= most else df
