"""Session settings the operators read; nothing here is global state."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_CONF = "spark.prefrank.groupRows"
BROADCAST_ROWS_CONF = "spark.prefrank.broadcastRows"
BROADCAST_BYTES_CONF = "spark.prefrank.broadcastBytes"


def group_rows(spark: SparkSession) -> int:
    """Most rows of one group that a single task may hold; larger groups are cut into strips."""
    return int(spark.conf.get(GROUP_ROWS_CONF, "1000000"))


def broadcast_rows(spark: SparkSession) -> int:
    """Most rows of a table that is sent to every executor; checked by a count before use."""
    return int(spark.conf.get(BROADCAST_ROWS_CONF, "200000"))


def broadcast_bytes(spark: SparkSession) -> int:
    """Most bytes of a table that is sent to every executor; counted with its rows."""
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(64 << 20)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder; only a session on one machine may lack it and gets a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder, so that later reads all see the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests, bench and notebooks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("prefrank")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
