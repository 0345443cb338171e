"""SQL over the tables, with named parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query(
    spark: SparkSession,
    sql: str,
    params: dict[str, Any] | None = None,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Run SQL with ``:name`` parameters; ``{name}`` stands for a given DataFrame.

    An empty result keeps its columns, and errors are raised.
    """
    return spark.sql(sql, args=params or {}, **(tables or {}))
