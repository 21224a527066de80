"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir

#: A word is a run of characters other than these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder within the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """`rows` written as Parquet to the shared checkpoint folder and read back, so that Spark knows their size."""
    path = shared_folder(rows.sparkSession, "table")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def packed(rows: DataFrame, name: str = "row") -> Column:
    """All columns of `rows` as one struct, so that working columns never clash with names of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name)
