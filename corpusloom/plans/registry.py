"""Query catalogue: each entry pairs a Spark query over the tables with its SQL check.

Input rows that the tables lack (links of certain sites, manifests, payloads) are derived from
the tables by SQL text that both engines read, so a query's work grows with its tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
_PLACEHOLDER = re.compile(r"\{(" + "|".join(TABLES) + r")\}")
_QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """Access to one folder of tables: `t["pages"]`, or `t.sql("select ... from {pages}")`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def wide(self, name: str) -> DataFrame:
        """The table over at least as many partitions as cores, for heavy per-row work."""
        return spread(self[name])

    def sql(self, text: str) -> DataFrame:
        def view(match: re.Match) -> str:
            return f"parquet.`{self.path(match.group(1))}`"

        return self.spark.sql(_PLACEHOLDER.sub(view, text))


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is DuckDB SQL with the same `{table}` placeholders."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = _PLACEHOLDER.sub(r"\1", oracle)
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    bind = lambda fn: lambda spark, folder: fn(Tables(spark, folder))
    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from . import (  # noqa: F401
        corpus_queries,
        media_queries,
        page_queries,
        reference_queries,
        stream_queries,
        task_queries,
        transcript_queries,
    )
