"""The catalog of chunks and windows: incremental upkeep, listings and neighbours."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.session import exists

#: Changes with the rules by which windows are cut; windows of another version are made anew.
WINDOW_VERSION = "1"
META = "key string, value string"
MANIFEST = "name string, bucket int, digest string, version int, kinds string"
BUCKETS = 64


def catalog_diff(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """(id, status): NEW, CHANGED, KEPT or STALE of chunks (id, content_sha); of repeated ids of `new` the largest digest counts."""
    after = new.groupBy("id").agg(F.max("content_sha").alias("new_sha"))
    both = old.select("id", F.col("content_sha").alias("old_sha")).join(after, "id", "full")
    same = (F.col("old_sha") == F.col("new_sha")) & F.lit(not force)
    status = F.when(F.col("new_sha").isNull(), "STALE").when(F.col("old_sha").isNull(), "NEW").when(same, "KEPT").otherwise("CHANGED")
    return both.select("id", status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """The catalog after an index run: rows of `new`, with the vector of an unchanged row kept and that of a changed one null."""
    vectors = old.select("id", F.col("content_sha").alias("old_sha"), F.col("vec").alias("old_vec"))
    same = (F.col("content_sha") == F.col("old_sha")) & F.lit(not force)
    others = [c for c in new.columns if c != "vec"]
    return new.join(vectors, "id", "left").select(*others, F.when(same, F.col("old_vec")).alias("vec"))


def pending(windows: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Windows whose vector is missing or of another model."""
    return windows if force else windows.where(F.col("vec").isNull() | F.col("vec_model").isNull() | (F.col("vec_model") != model))


@dataclass
class Catalog:
    """Chunks (with id and content_sha), their windows (with id, chunk_id, content_sha, vec, vec_model) and meta (key, value)."""

    chunks: DataFrame
    windows: DataFrame
    meta: DataFrame


def set_meta(meta: DataFrame, **values: object) -> DataFrame:
    """The table with these keys set, whatever they were before."""
    fresh = meta.sparkSession.createDataFrame([(k, str(v)) for k, v in values.items()], META)
    return meta.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def get_meta(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return default if row is None else row["value"]


def migrated(catalog: Catalog) -> Catalog:
    """A catalog of an older form: columns that it lacks are added, and vectors of chunks, which windows hold now, are dropped
    with the windows still to be made."""
    chunks, windows = catalog.chunks.drop("vec", "vec_model"), catalog.windows
    for name, kind in (("vec", "array<float>"), ("vec_model", "string")):
        windows = windows if name in windows.columns else windows.withColumn(name, F.lit(None).cast(kind))
    return Catalog(chunks, windows, catalog.meta)


def index_run(old: Catalog | None, chunks: DataFrame, windows: DataFrame, force: bool = False, version: str = WINDOW_VERSION) -> Catalog:
    """The catalog after an index run over new chunks and their windows. Windows of kept chunks keep their vectors, unless their rules
    have changed version; those of new and changed chunks, and of all when forced, wait for theirs; what is no longer made is gone."""
    spark = chunks.sparkSession
    waiting = windows.select("id", "chunk_id", "ord", "text", "content_sha", F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("string").alias("vec_model"))
    if old is None:
        return Catalog(chunks, waiting, set_meta(spark.createDataFrame([], META), window_version=version))
    old = migrated(old)
    meta = set_meta(old.meta, window_version=version)
    if force or get_meta(old.meta, "window_version") != version:
        return Catalog(chunks, waiting, meta)
    kept = catalog_diff(old.chunks, chunks).where("status = 'KEPT'").select(F.col("id").alias("chunk_id"))
    known = old.windows.join(kept, "chunk_id", "left_semi")
    fresh = waiting.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return Catalog(chunks, known.select(*fresh.columns).unionByName(fresh), meta)


def run_counts(old: Catalog | None, chunks: DataFrame, force: bool = False) -> DataFrame:
    """One row of an index run: how many chunks are new or changed, kept, and stale."""
    before = chunks.select("id", "content_sha").where("false") if old is None else old.chunks
    n = lambda *names: F.count(F.when(F.col("status").isin(*names), 1))
    return catalog_diff(before, chunks, force).agg(n("NEW", "CHANGED").alias("n_new"), n("KEPT").alias("n_kept"), n("STALE").alias("n_stale"))


#: Texts to vectors: what an embedding model is plugged in as.
Embedder = Callable[[Column], Column]


def embedded(windows: DataFrame, embedder: Embedder, model: str, force: bool = False) -> DataFrame:
    """The windows with vectors of the model for those that lack one, or have one of another model."""
    lacks = F.lit(force) | F.col("vec").isNull() | F.col("vec_model").isNull() | (F.col("vec_model") != model)
    return windows.withColumns({"vec": F.when(lacks, embedder(F.col("text"))).otherwise(F.col("vec")), "vec_model": F.lit(model)})


def write_catalog(catalog: Catalog, path: str) -> str:
    """Writes a new version of the catalog beside the older ones, which its rows may come from, and names it last: a run that
    breaks off leaves the version before.

    Rows are dealt to buckets by their chunk. A bucket that is as it was, by a digest over its rows, is not written: the manifest of the new version
    points to the older one's files. So what is written follows what changed.
    """
    spark = catalog.chunks.sparkSession
    number = (_last_version(spark, path) or 0) + 1
    before = {} if number == 1 else {(r["name"], r["bucket"]): r for r in spark.read.parquet(f"{path}/version={number - 1}/manifest").collect()}
    manifest = []
    for name, key in (("chunks", "id"), ("windows", "chunk_id")):
        rows = getattr(catalog, name)
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        told = F.sum(F.xxhash64(F.lit(rows.schema.simpleString()), *rows.columns).cast("decimal(38,0)")).cast("string")
        digests = {r["bucket"]: r["digest"] for r in dealt.groupBy("bucket").agg(told.alias("digest")).collect()}
        changed = [b for b, digest in digests.items() if (name, b) not in before or before[name, b]["digest"] != digest]
        kinds = StructType([*rows.schema.fields])
        if changed:
            dealt.where(F.col("bucket").isin(*changed)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}/{name}")
        manifest += [(name, b, digest, number if b in set(changed) else before[name, b]["version"], kinds.json()) for b, digest in digests.items()]
        if not digests:
            manifest.append((name, -1, "", number, kinds.json()))
    catalog.meta.write.mode("overwrite").parquet(f"{path}/version={number}/meta")
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}/manifest")
    spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return f"{path}/version={number}"


def _last_version(spark: SparkSession, path: str) -> int | None:
    return spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0] if exists(spark, f"{path}/versions/_SUCCESS") else None


def open_catalog(spark: SparkSession, path: str) -> Catalog | None:
    """The last whole version of a catalog, in the present form; None where there is none."""
    number = _last_version(spark, path)
    if number is None:
        return None
    held = spark.read.parquet(f"{path}/version={number}/manifest").collect()

    def rows(name: str) -> DataFrame:
        parts = [r for r in held if r["name"] == name]
        schema = StructType.fromJson(json.loads(parts[0]["kinds"]))
        paths = [f"{path}/version={r['version']}/{name}/bucket={r['bucket']}" for r in parts if r["bucket"] >= 0]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    return migrated(Catalog(rows("chunks"), rows("windows"), spark.read.parquet(f"{path}/version={number}/meta")))


def books_listing(chunks: DataFrame) -> DataFrame:
    """A row for each book: chunks, and different images."""
    return chunks.groupBy("book_file", "book_title", "author").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("image").alias("n_images"))


def catalog_summary(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks, with a page, with an author, and their lengths."""
    size = F.length("text")
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("book_file").alias("n_books"), F.count(F.when(F.col("page").isNotNull(), 1)).alias("n_paged"),
        F.count(F.when(F.coalesce("author", F.lit("")) != "", 1)).alias("n_authored"), F.min(size).cast("long").alias("min_chars"), F.max(size).cast("long").alias("max_chars"), F.round(F.avg(size), 3).alias("avg_chars"),
    )


def chunks_by_book(chunks: DataFrame) -> DataFrame:
    """(book_file, n_chunks), the fullest books first."""
    return chunks.groupBy("book_file").agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(F.desc("n_chunks"), "book_file")


def neighbours(pages: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """Pages (book_file, image, ...) of the hits' books within `around` images of a hit (book_file, image), in image order."""
    rank = F.dense_rank().over(W.partitionBy("book_file").orderBy("image"))
    placed = pages.withColumn("place", rank)
    centre = placed.join(hits.select("book_file", "image").distinct(), ["book_file", "image"], "left_semi").select("book_file", F.col("image").alias("hit"), F.col("place").alias("centre")).distinct()
    return placed.join(centre, "book_file").where(F.abs(F.col("place") - F.col("centre")) <= around).drop("place", "centre")
