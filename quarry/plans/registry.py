"""Where queries are registered: name, the operators they apply, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}


def query(name: str, operators: str, oracle: str | None = None):
    """Register f(spark, sf_dir) under name; operators: inventory ids it covers; oracle: the same rows in DuckDB's SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name], OPERATORS[name] = f, operators.split()
        if oracle:
            SQL[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, for work that costs much a row: dealt anew where their files make fewer tasks than there are cores, and left where they lie otherwise."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def run_sql(spark: SparkSession, sf_dir: str, text: str, *names: str, **more: DataFrame) -> DataFrame:
    """Spark SQL over {name} for each table named."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names}, **more)
