"""Named queries over a folder of parquet tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefrank.plans.adapters import ADAPTERS, BASE_TABLES, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables and to the adapter tables built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.read(name)
        if name not in ADAPTERS:
            raise AttributeError(name)
        sql, bases = with_adapters(f"SELECT * FROM {name}", [name], "{%s}")
        return self.spark.sql(sql, **{b: self.read(b) for b in bases})


def with_adapters(body: str, names: list[str], table: str = "%s") -> tuple[str, list[str]]:
    """Prefix `body` with the CTEs of the named adapters, and list the base tables they read."""
    order, bases = needed(names)
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in order)
    if table == "%s":  # spark.sql fills its own placeholders; the SQL side is filled here
        ctes = ctes.format(**{b: b for b in BASE_TABLES}).replace("element_at(", "list_extract(")
    lead = "WITH " if order else ""
    if order and body.lstrip().upper().startswith("WITH "):
        return f"{lead}{ctes},\n{body.lstrip()[5:]}", bases
    return f"{lead}{ctes}\n{body}", bases


def query(name: str, oracle: str | None = None, uses: str = ""):
    """Register `fn(t: Tables) -> DataFrame`; `uses` lists the adapters the SQL text names."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[name] = with_adapters(oracle, uses.split())[0]
        return fn

    return register
