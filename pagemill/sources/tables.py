"""The parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`name` of the folder `sf_dir`, through Spark's reader alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
