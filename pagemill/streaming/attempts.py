"""Work on rows that goes on past those that fail, and keeps a record of each failure.

Results and failures are two tables. A row whose work raises goes to the failures with its error, the number of the attempt and the row
itself; the rest is written. A later run takes up what has no result and fewer than `most` attempts, whether rows come again or only
from the failures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagemill.session import delete_folder, exists, shared_path

MOST = 8
ERROR_CHARS = 2000


def attempted(rows: DataFrame, work: Callable[[dict], dict], schema: str | StructType) -> DataFrame:
    """`rows` with `done`, a struct of `schema` that `work` makes of each row, or null and the `error` that it raised."""
    kind = rows.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    names = rows.columns
    made = StructType([*rows.schema.fields, StructField("done", kind), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done, errors = [], []
            for values in zip(*(frame[c] for c in names), strict=True):
                try:
                    done.append(work(dict(zip(names, values, strict=True))))
                    errors.append(None)
                except Exception as failed:  # any failure is that row's own
                    done.append(None)
                    errors.append(f"{type(failed).__name__}: {failed}"[:ERROR_CHARS])
            out = frame.copy()
            out["done"], out["error"] = pd.Series(done, dtype=object, index=frame.index), pd.Series(errors, dtype=object, index=frame.index)
            yield out

    return rows.mapInPandas(run, made)


def open_failures(spark: SparkSession, path: str, rows: StructType) -> DataFrame:
    """(row, attempt, error, at) of all failures so far."""
    schema = StructType([StructField("row", rows), StructField("attempt", IntegerType()), StructField("error", StringType()), StructField("at", StringType())])
    return spark.read.schema(schema).parquet(path) if exists(spark, f"{path}/_SUCCESS") else spark.createDataFrame([], schema)


def run_rows(rows: DataFrame, key: str, work: Callable[[dict], dict], schema: str, results: str, failures: str, at: str | Column = "", most: int = MOST) -> tuple[int, int]:
    """(done, failed): works on those of `rows` that have no result and fewer than `most` failures, and appends to both tables.

    What was made is written once before it is parted, so no row is worked on twice in a run. Rows of one key are one row. A run that breaks off
    between the tables leaves rows that the next one works on again.
    """
    spark = rows.sparkSession
    waiting = rows.dropDuplicates([key])
    if exists(spark, f"{results}/_SUCCESS"):
        waiting = waiting.join(spark.read.parquet(results).select(key), key, "left_anti")
    tried = open_failures(spark, failures, rows.schema).groupBy(F.col(f"row.{key}").alias(key)).agg(F.max("attempt").alias("tried"))
    waiting = waiting.join(tried, key, "left").where(F.coalesce("tried", F.lit(0)) < most).select(*rows.columns, F.coalesce("tried", F.lit(0)).alias("_tried"))
    stage = shared_path(spark, "attempts", fresh=True)
    # The work sees the row as it came.
    numbered = waiting.select(*rows.columns, "_tried")
    attempted(numbered, lambda row: work({c: v for c, v in row.items() if c != "_tried"}), schema).write.parquet(stage)
    made = spark.read.parquet(stage)
    sound, broken = made.where("error is null"), made.where("error is not null")
    counts = made.agg(F.count(F.when(F.col("error").isNull(), 1)), F.count("error")).first()
    sound.select(key, "done.*").write.mode("append").parquet(results)
    kept = F.struct(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    broken.select(kept.alias("row"), (F.col("_tried") + 1).cast("int").alias("attempt"), "error", (F.lit(at) if isinstance(at, str) else at).alias("at")).write.mode("append").parquet(failures)
    delete_folder(spark, stage)
    return counts[0], counts[1]


def retry(spark: SparkSession, rows: StructType, key: str, work: Callable[[dict], dict], schema: str, results: str, failures: str, at: str = "", most: int = MOST) -> tuple[int, int]:
    """Works again on the rows in the failures that have no result yet."""
    last = open_failures(spark, failures, rows).groupBy(F.col(f"row.{key}").alias("k")).agg(F.max_by("row", "attempt").alias("row"))
    return run_rows(last.select("row.*"), key, work, schema, results, failures, at, most)


def stream_rows(rows: DataFrame, key: str, work: Callable[[dict], dict], schema: str, results: str, failures: str, checkpoint: str, most: int = MOST) -> StreamingQuery:
    """`run_rows` for every micro-batch of a stream."""

    def write(batch: DataFrame, number: int) -> None:
        run_rows(batch, key, work, schema, results, failures, f"batch {number}", most)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
