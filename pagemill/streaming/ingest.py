"""Incremental ingest and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagemill.operators import catalog, chunking
from pagemill.session import exists

BUCKETS = 64


def page_stream(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 100) -> DataFrame:
    """Page units arriving as Parquet files; what has been read is known from the checkpoint, so a restart goes on where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(pages: DataFrame, target: str, checkpoint: str, paragraph: str = chunking.PARAGRAPH) -> StreamingQuery:
    """Chunks of each micro-batch that the catalog does not hold yet, appended to it.

    A batch that runs again finds its own rows, so nothing is written twice; a changed page adds a row under its id with a new digest,
    and `latest` picks it. Rows lie in `BUCKETS` folders by a hash of their id, and a batch reads the ids and digests of those it
    falls in.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        chunks = chunking.chunk_units(batch, paragraph).withColumns({"batch": F.lit(number), "bucket": F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")})
        if exists(spark, f"{target}/_SUCCESS"):
            met = [r["bucket"] for r in chunks.select("bucket").distinct().collect()]
            held = spark.read.parquet(target).where(F.col("bucket").isin(*met)).select("id", "content_sha")
            chunks = chunks.join(held, ["id", "content_sha"], "left_anti")
        chunks.write.mode("append").partitionBy("bucket").parquet(target)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(chunks: DataFrame) -> DataFrame:
    """The newest row of every id."""
    others = [c for c in chunks.columns if c not in ("id", "batch", "bucket")]
    return chunks.groupBy("id").agg(F.max_by(F.struct(*others), "batch").alias("row"), F.max("batch").alias("batch")).select("id", "row.*", "batch")


def dead_letters(rows: DataFrame, broken: str = "_broken") -> tuple[DataFrame, DataFrame]:
    """(sound rows, broken rows) of a stream or table read permissively."""
    return rows.where(F.col(broken).isNull()).drop(broken), rows.where(F.col(broken).isNotNull()).select(broken)


def session_counts(events: DataFrame, late: str = "1 hour", gap: str = "21600 seconds") -> DataFrame:
    """Sessions of a user by six-hour gaps, closed once the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a full recompute would change in the catalog: counts by status."""
    return catalog.catalog_diff(old, new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
