"""What a batch leaves behind: book files, the index, the report, event and evaluation logs; and the readers of the latter.

Everything is a table of lines or texts until it is written, so a batch of any number of works is written by its tasks. Writing over
a folder removes what it held before, as names of works change between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import duration, heading_anchor, slug, strip, yaml_value
from pagemill.functions.titles import clean_metadata, metadata_docs
from pagemill.plans.audit import recovered_body

RECOVERED = "_(text recovered from a cover/imprint shot)_"
FIELDS = ("author", "publisher", "year", "isbn", "city", "call_number")
# How the report calls the fields.
LABELS = {"author": "Author", "publisher": "Publisher", "year": "Year", "isbn": "ISBN", "city": "City", "call_number": "Call no."}
LOW_QUALITY = 0.5
PROBES = "query string, book string, image string, page string"
HISTORY = "at string, mode string, chunks long, books long, probes long, embed_model string, rerank_model string, r1 double, r3 double, r5 double, mrr double"


def numbered(works: DataFrame) -> DataFrame:
    """Works (work, title) with a number in the order of their first shots and the name of their files. Works are few beside shots."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.orderBy("work"))
    return works.withColumn("number", number).withColumn("name", F.concat(F.lit("book_"), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("_"), slug(F.col("title"))))


def _body(role: Column, raw_md: Column, ocr_text: Column) -> Column:
    """The text of a shot's section: its own, or what is recovered from a cover; null for none."""
    recovered = recovered_body(role, ocr_text)
    own = F.when((role == "body") & (strip(F.coalesce(raw_md, F.lit(""))) != ""), raw_md)
    return F.coalesce(own, F.when(recovered.isNotNull(), F.concat(F.lit(f"{RECOVERED}\n\n"), recovered)))


def book_texts(shots: DataFrame, records: DataFrame) -> DataFrame:
    """(name, markdown) of works: shots (work, capture_no, image, role, raw_md, ocr_text, metadata, and seeds where works were joined)
    and numbered records (work, name, title, fields, note)."""
    if "seeds" not in shots.columns:
        shots = shots.withColumn("seeds", F.array("work"))
    section = F.concat(F.lit("## "), F.col("image"), F.lit("\n\n"), _body(F.col("role"), F.col("raw_md"), F.col("ocr_text")), F.lit("\n"))
    docs = F.when(strip(F.coalesce("metadata", F.lit(""))) != "", metadata_docs(clean_metadata(F.col("metadata"))))
    told = shots.groupBy("work").agg(
        F.array_sort(F.collect_list(F.struct("capture_no", "image", section.alias("section")))).alias("sections"), F.count(F.lit(1)).alias("n"), F.first("seeds").alias("seeds"),
        F.min_by(docs, F.when(docs.isNotNull(), F.col("capture_no"))).alias("docs"),
    ).join(records, "work")
    head = F.filter(F.array(F.struct(F.lit("title").alias("k"), F.col("title").alias("v")), *[F.struct(F.lit(f).alias("k"), F.col("fields")[f].alias("v")) for f in FIELDS]), lambda p: p["v"].isNotNull())
    front = F.array_join(F.transform(head, lambda p: F.concat(p["k"], F.lit(": "), yaml_value(p["v"]))), "\n")
    parts = F.array(
        F.concat(F.lit("---\n"), front, F.lit("\n---\n")), F.concat(F.lit("# "), F.col("title"), F.lit("\n")),
        F.when(F.size("seeds") > 1, F.concat(F.lit("> _Assembled from "), F.col("n").cast("string"), F.lit(" shots across multiple readings (seeds: "), F.array_join("seeds", ", "), F.lit(")._\n"))),
        F.when(F.col("note").isNotNull(), F.concat(F.lit("> **Bibliography**: "), F.col("note"), F.lit("\n"))),
        F.when(F.size("docs") > 1, F.concat(F.lit("> _Other books visible in the cover/shelf photo:_\n\n```yaml\n"), F.array_join(F.slice("docs", 2, F.size("docs")), "\n\n"), F.lit("\n```\n"))),
    )
    whole = F.array_join(F.concat(F.filter(parts, lambda p: p.isNotNull()), F.filter(F.transform("sections", lambda s: s["section"]), lambda s: s.isNotNull())), "\n")
    return told.select("name", F.concat(strip(whole), F.lit("\n")).alias("markdown"))


def index_lines(shots: DataFrame, records: DataFrame) -> DataFrame:
    """(image, line): a row of the index for each shot, with its book's number and how its reading went."""
    body, meta = F.col("role") == "body", F.col("role") == "meta"
    fields = strip(F.coalesce("metadata", F.lit(""))) != ""
    status = (
        F.when(body & (strip(F.coalesce("raw_md", F.lit(""))) == ""), "empty").when(meta & recovered_body(F.col("role"), F.col("ocr_text")).isNotNull(), F.when(fields, "ok").otherwise("recovered"))
        .when(meta & ~fields, "no-fields").otherwise("ok")
    )
    figures = F.when(F.size("figures") > 0, F.size("figures").cast("string")).otherwise("")
    joined = shots.join(records.select("work", "number"), "work", "left")
    cells = [F.col("image"), F.coalesce("type", F.lit("")), F.coalesce(F.col("number").cast("string"), F.lit("-")), figures, status]
    return joined.select("image", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report_sections(shots: DataFrame, records: DataFrame, summary: DataFrame) -> DataFrame:
    """(number, markdown): a section of the report for each work: title and fields, when and how it was taken, its covers and pages."""
    pages = F.array_join(F.transform(F.coalesce("page_numbers", F.array().cast("array<int>")), lambda n: n.cast("string")), ", ")
    warned = F.when(F.col("quality") < LOW_QUALITY, F.format_string(" · low read quality (%.2f)", "quality")).otherwise("")
    held = (F.col("role") == "body") & (strip(F.coalesce("raw_md", F.lit(""))) != "")
    item = F.concat(F.lit("- ["), F.col("image"), F.lit("]("), F.col("name"), F.lit(".md#"), heading_anchor(F.col("image")), F.lit(")"), F.when(pages != "", F.concat(F.lit(" — p. "), pages)).otherwise(""), warned)
    rows = shots.join(records.select("work", "name"), "work").groupBy("work").agg(
        F.array_sort(F.collect_list(F.when(held, F.struct("capture_no", item.alias("line"))))).alias("pages"), F.array_sort(F.collect_list(F.when(F.col("role") == "meta", F.struct("capture_no", F.col("image").alias("line"))))).alias("covers")
    )
    told = records.join(summary, "work").join(rows, "work")
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- **{label}:** "), value))
    span = F.concat(F.date_format("first_time", "yyyy-MM-dd HH:mm"), F.lit(" → "), F.when(F.to_date("first_time") == F.to_date("last_time"), F.date_format("last_time", "HH:mm")).otherwise(F.date_format("last_time", "yyyy-MM-dd HH:mm")), F.lit(" ("), F.col("duration"), F.lit(", "), F.col("n_images").cast("string"), F.lit(" shots)"))
    parts = F.array(
        F.concat(F.lit("## "), F.col("number").cast("string"), F.lit(". ["), F.col("title"), F.lit("]("), F.col("name"), F.lit(".md)\n")),
        F.concat(F.lit("_"), F.col("n_images").cast("string"), F.when(F.col("n_images") == 1, " image").otherwise(" images"), F.coalesce(F.concat(F.lit(" · read "), F.date_format("latest_run", "yyyy-MM-dd HH:mm")), F.lit("")), F.coalesce(F.concat(F.lit(" · text yield p50 "), F.col("yield_p50").cast("string")), F.lit("")), F.lit("_\n")),
        line("Title", F.col("title")), *[line(LABELS[f], F.col("fields")[f]) for f in FIELDS], line("Bibliography", F.col("note")), line("Captured", span), line("Cover/title shot(s)", F.array_join(F.transform("covers", lambda c: c["line"]), ", ")),
        F.when(F.size("pages") > 0, F.concat(F.lit("\nPages:\n"), F.array_join(F.transform("pages", lambda p: p["line"]), "\n"))),
    )
    return told.select("number", F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n"), F.lit("\n")).alias("markdown"))


def events(records: DataFrame, at: str) -> DataFrame:
    """(value): a JSON line for each freshly read shot, with what it cost and how it went; `records` has elapsed_s beside PAGE_RECORD."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    kept = [c for c in ("image", "type", "role", "rotation", "orient_passes", "orient_probes", "pass_stats", "text_score", "quality", "page_numbers", "model", "prompt_version") if c in records.columns]
    told = F.struct(F.lit(at).alias("timestamp"), *kept, F.round("elapsed_s", 2).alias("elapsed_s"), F.length(F.coalesce("ocr_text", F.lit(""))).alias("n_chars"), size(F.col("figures").cast("array<string>")).alias("figures"), (strip(F.coalesce("metadata", F.lit(""))) != "").alias("has_metadata"))
    return records.select(F.to_json(told).alias("value"))


def upserted_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cache of page records with fresh ones in place of those of the same image; of several the one read last."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy("image").agg(F.max_by(F.struct(*both.columns), F.struct(F.col("processed_at").isNotNull(), "processed_at")).alias("row")).select("row.*")


def write_texts(rows: DataFrame, path: str) -> None:
    """Texts (name, markdown) as one folder a name, in place of whatever the folder held."""
    rows.select("name", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """JSON lines (value), or rows as such, behind those that a log holds."""
    (rows if rows.columns == ["value"] else rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; lines that do not parse are left out."""
    row = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return spark.read.text(path).select(row.alias("row")).select("row.*").where("_broken is null").drop("_broken")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, PROBES)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, HISTORY)
