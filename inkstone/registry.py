"""Every query outside the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import read
from .plans.dialect import DUCK, SPARK

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
TABLES = ("documents", "benchmark", "labels", "events", "conversations", "pages", "customer", "orders", "lineitem", "nation", "region", "part", "supplier")


def given(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The given tables as temporary views."""
    for name in names:
        read(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def both(text: Callable) -> Callable:
    """Register a query whose text, for either dialect, the function returns; tables are found by name in the text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = text(SPARK)
        given(spark, sf_dir, *(t for t in TABLES if t in sql))
        return spark.sql(sql)

    QUERIES[text.__name__] = (run, text(DUCK))
    return text


def query(sql: str | None = None) -> Callable:
    """Register a query that is built with DataFrames, with its SQL."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


from .plans import bibliography, calibration, library, search, text  # noqa: E402, F401
