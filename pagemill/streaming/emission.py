"""Outputs that follow what changed: a batch of page records rewrites the files of the works that it touches, and no others.

A folder holds `records` (page records by bucket of rolls), `lines` (the index, a row an image, likewise), `emitted` (name and digest of every book of a
bucket) and `books` (a folder a name). A batch adds its records to those of its buckets and groups their rolls anew; works of other rolls cannot
change, as a work lies within a roll. Books whose text has another digest than before are written in place of the old ones, books that are no
more are removed, and the rest is left alone. A batch that runs again finds everything as it should be and writes nothing, so
outputs are right after any number of retries; `emitted` is written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagemill.functions.text import slug
from pagemill.operators import capture, works
from pagemill.session import delete_folder, ensure_checkpoint_dir, exists
from pagemill.sources import reports

BUCKETS = 256


def _bucket(roll: Column) -> Column:
    return F.pmod(F.xxhash64(roll.cast("string")), F.lit(BUCKETS)).cast("int")


def _held(spark: SparkSession, path: str, schema: StructType, buckets: list[int]) -> DataFrame:
    """The rows of some buckets of a table, none before anything was written."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(*buckets)).select(*schema.names)


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def assembled_books(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books (roll, name, markdown), index lines (roll, image, line)) of whole rolls of page records. A book is named by its first shot and its title,
    which, other than a number, stay as they are when other works come."""
    ensure_checkpoint_dir(records.sparkSession)
    grouped = capture.group_shots(records)
    shots = records.join(grouped.select("roll", "image", "capture_no", "work", "work_title", "key_image", "title_counts"), ["roll", "image"]).checkpoint()
    told = works.work_records(shots, works.work_titles(shots))
    stem = F.regexp_replace("work", r"\.[^.]*$", "")
    named = told.withColumns({"name": F.concat(F.lit("book_"), slug(stem), F.lit("_"), slug(F.col("title"))), "number": stem})
    rolls = shots.groupBy("work").agg(F.min("roll").alias("roll"))
    texts = reports.book_texts(shots, named).join(named.select("name", "work"), "name").join(rolls, "work").select("roll", "name", "markdown")
    lines = reports.index_lines(shots, named).join(shots.select("image", "roll"), "image").select("roll", "image", "line")
    return texts, lines


def emit(batch: DataFrame, target: str) -> DataFrame:
    """(name, change) of the books that a batch of page records (with roll, and images unique in the library) touches: NEW, CHANGED, GONE or KEPT, after all
    outputs under `target` are up to date."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    fresh = batch.withColumn("bucket", _bucket(F.col("roll"))).checkpoint()
    buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    if not buckets:
        return spark.createDataFrame([], "name string, change string")
    rows = reports.upserted_records(_held(spark, f"{target}/records", fresh.schema, buckets), fresh).checkpoint()
    texts, lines = assembled_books(rows.drop("bucket"))
    made = texts.select("*", F.sha2("markdown", 256).alias("digest"), _bucket(F.col("roll")).alias("bucket")).checkpoint()
    before = _held(spark, f"{target}/emitted", made.select("bucket", "name", "digest").schema, buckets)
    both = made.select("name", F.col("digest").alias("new")).join(before.select("name", F.col("digest").alias("old")), "name", "full")
    change = F.when(F.col("new").isNull(), "GONE").when(F.col("old").isNull(), "NEW").when(F.col("old") == F.col("new"), "KEPT").otherwise("CHANGED")
    feed = both.select("name", change.alias("change")).checkpoint()
    _replace(rows, f"{target}/records")
    _replace(lines.withColumn("bucket", _bucket(F.col("roll"))), f"{target}/lines")
    touched = made.join(feed.where("change in ('NEW', 'CHANGED')"), "name", "left_semi")
    touched.select("name", F.col("markdown").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(f"{target}/books")
    for row in feed.where("change = 'GONE'").toLocalIterator():
        delete_folder(spark, f"{target}/books/name={row['name']}")
    _replace(made.select("bucket", "name", "digest"), f"{target}/emitted")
    return feed


def emit_stream(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """`emit` for every micro-batch of a stream of page records."""
    return records.writeStream.foreachBatch(lambda batch, number: emit(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
