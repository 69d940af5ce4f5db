"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, as a file or as a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
