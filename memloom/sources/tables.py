"""The project's tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.workspace import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned and filters pushed down by the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
