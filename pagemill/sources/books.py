"""Book Markdown, bibliographies, hint files and page records: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import lines, strip, yaml_value

PAGE_RECORD = (
    "image string, type string, role string, rotation int, orient_passes int, orient_probes int, text_score int, quality double, "
    "pass_stats struct<seconds: double, prompt_tokens: int, generation_tokens: int, prompt_tps: double, generation_tps: double, finish_reason: string>, "
    "figures array<string>, raw_md string, ocr_text string, cover_title string, metadata string, running_header string, page_numbers array<int>, "
    "datetime timestamp_ntz, gps array<double>, model string, prompt_version string, processed_at timestamp_ntz"
)
IMAGE_HEADING = r"(?i)^##\s+(\S.*\.(?:jpe?g|png|tiff?|heic))\s*$"
PAGE_HEADING = r"(?i)^###\s+Page\s+(\S+)"


def read_page_records(spark: SparkSession, path: str, model: str | None = None, prompt_version: str | None = None) -> DataFrame:
    """Page records of JSON files, one a file; broken files are left out, and so are those of another model or prompt."""
    rows = spark.read.schema(PAGE_RECORD + ", _broken string").option("columnNameOfCorruptRecord", "_broken").option("multiLine", True).json(path)
    kept = rows.where("_broken is null and image is not null").drop("_broken")
    for name, wanted in (("model", model), ("prompt_version", prompt_version)):
        if wanted is not None:
            kept = kept.where(F.col(name) == wanted)
    place = F.when(F.size("gps") == 2, F.struct(F.col("gps")[0].alias("lat"), F.col("gps")[1].alias("lon")))
    return kept.withColumn("gps", place)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the image files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpeg,jpg,JPG,png}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def degrees(parts: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds as a signed number with three decimals."""
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return F.bround(F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value), 3)


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(fields as a map, body) of a Markdown text."""
    block = F.regexp_extract(raw, r"(?s)\A---\n?(.*?)\n---", 1)
    body = F.when(raw.rlike(r"(?s)\A---.*?\n---"), F.regexp_replace(raw, r"(?s)\A---.*?\n---", "")).otherwise(raw)
    told = F.filter(lines(block), lambda x: x.contains(":") & ~strip(x).startswith("#"))
    pairs = F.transform(told, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(strip(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last), body


def parse_books(raw: DataFrame) -> DataFrame:
    """Page units (book_file, book_title, author, year, image, page, position, text) of whole files (book_file, raw).

    A line is placed by running values over its file: the last image heading, the last page heading since that, and a count
    of headings that numbers the units. Other headings are text; lines before the first image are not.
    """
    fields, body = front_matter(F.col("raw"))
    files = raw.select("book_file", fields.alias("fields"), body.alias("body"))
    h1 = F.get(F.filter(lines(F.col("body")), lambda x: x.startswith("# ")), F.lit(0))
    title = F.coalesce(F.nullif(F.col("fields")["title"], F.lit("")), strip(F.substring(h1, 3, 1_000_000)), F.regexp_replace("book_file", r"\.[^.]*$", ""))
    head = files.select("book_file", title.alias("book_title"), F.coalesce(F.col("fields")["author"], F.lit("")).alias("author"), F.coalesce(F.col("fields")["year"], F.lit("")).alias("year"), F.posexplode(lines(F.col("body"))).alias("line_no", "line"))
    page = F.when(F.col("line").rlike(PAGE_HEADING), strip(F.regexp_extract("line", PAGE_HEADING, 1)))
    image = F.when(page.isNull() & F.col("line").rlike(IMAGE_HEADING), strip(F.regexp_extract("line", IMAGE_HEADING, 1)))
    order = W.partitionBy("book_file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = head.withColumn("new_page", page).withColumn("new_image", image)
    border = F.col("new_page").isNotNull() | F.col("new_image").isNotNull()
    placed = marked.select("*", F.last("new_image", True).over(order).alias("image"), F.sum(border.cast("int")).over(order).alias("unit"), F.last(F.when(border, F.struct(F.col("new_page").alias("page"))), True).over(order)["page"].alias("page"))
    kept = placed.where(~border & F.col("image").isNotNull() & ~F.col("line").startswith("# "))
    units = kept.groupBy("book_file", "book_title", "author", "year", "image", "page", F.col("unit").alias("position")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    text = strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return units.select("book_file", "book_title", "author", "year", "image", "page", "position", text.alias("text")).where("text <> ''")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("pathGlobFilter", "book_*.md").text(path, wholetext=True)
    return parse_books(files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("book_file"), F.col("value").alias("raw")))


def parse_ris(raw: DataFrame) -> DataFrame:
    """Bibliography records of whole RIS texts (raw): position and nine fields; records without a title are left out."""
    told = raw.select(F.posexplode(F.split(F.regexp_replace("raw", r"^\ufeff", ""), r"(?m)^ER.*$")).alias("position", "record"))
    tagged = F.filter(lines(F.col("record")), lambda x: x.rlike(r"^[A-Z][A-Z0-9]\s+-"))
    pairs = F.transform(tagged, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), strip(F.regexp_replace(x, r"^[A-Z][A-Z0-9]\s+-\s?", "")).alias("value")))
    rows = told.withColumn("pairs", pairs)

    def tagged_as(tag: str) -> Column:
        return F.transform(F.filter("pairs", lambda p: p["tag"] == tag), lambda p: p["value"])

    def values(*tags: str) -> Column:
        """The values of the first of the tags that occurs."""
        lists = [tagged_as(t) for t in tags]
        return F.coalesce(*[F.when(F.size(v) > 0, v) for v in lists], F.array().cast("array<string>"))

    first = lambda *tags: F.coalesce(F.get(values(*tags), F.lit(0)), F.lit(""))
    out = rows.select(
        "position", first("TY").alias("type"), F.array_join(values("TI", "T1"), " ").alias("title"), first("T2").alias("container"), values("AU", "A1").alias("authors"), values("A3", "A2", "ED").alias("editors"),
        F.substring(first("PY", "Y1"), 1, 4).alias("year"), first("PB").alias("publisher"), first("SN").alias("isbn"), first("CY").alias("city"),
    )
    return out.where("title <> ''")


def parse_merges(raw: DataFrame) -> DataFrame:
    """Hints (position, kind, host, stems) of lines (position, value): split `! a`, move `h += a b`, group `a + b`."""
    text = strip(F.regexp_replace("value", "#.*$", ""))
    told = raw.select("position", text.alias("text")).where("text <> ''")
    stem = lambda x: F.regexp_replace(strip(x), r"\.[^.]*$", "")
    split_off = F.col("text").startswith("!")
    move = F.col("text").contains("+=")
    kind = F.when(split_off, "split").when(move, "move").otherwise("group")
    rest = F.when(split_off, F.array(F.substring("text", 2, 1_000_000))).when(move, F.split(F.regexp_replace("text", r"^.*?\+=", ""), r"[+\s]+")).otherwise(F.split("text", r"\+"))
    stems = F.filter(F.transform(rest, stem), lambda x: x != "")
    out = told.select("position", kind.alias("kind"), F.when(move & ~split_off, stem(F.substring_index("text", "+=", 1))).alias("host"), stems.alias("stems"))
    return out.where(((F.col("kind") == "group") & (F.size("stems") >= 2)) | ((F.col("kind") != "group") & (F.size("stems") >= 1) & F.coalesce(F.col("host") != "", F.lit(True))))


def parse_titles(raw: DataFrame) -> DataFrame:
    """(stem, title) of lines (position, value) `stem = title`; the last of repeated stems counts."""
    text = strip(F.regexp_replace("value", "#.*$", ""))
    told = raw.select("position", text.alias("text")).where(F.col("text").contains("="))
    stem = F.regexp_replace(strip(F.substring_index("text", "=", 1)), r"\.[^.]*$", "")
    title = strip(F.regexp_replace("text", r"^[^=]*=", ""))
    named = told.select("position", stem.alias("stem"), title.alias("title")).where("stem <> '' and title <> ''")
    return named.groupBy("stem").agg(F.max_by("title", "position").alias("title"))


def book_markdown(pages: DataFrame) -> DataFrame:
    """(book_id, markdown) of pages (book_id, title, author, year, image, page, position, text): front matter, title, one section a
    page."""
    section = F.concat(F.lit("## "), F.col("image"), F.lit("\n"), F.when(F.coalesce("page", F.lit("")) != "", F.concat(F.lit("### Page "), F.col("page"), F.lit("\n"))).otherwise(""), F.col("text"), F.lit("\n"))
    books = pages.groupBy("book_id", "title", "author", "year").agg(F.array_sort(F.collect_list(F.struct("position", "image", section.alias("section")))).alias("rows"))
    fields = [F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(f"{n}: "), yaml_value(F.col(n)))) for n in ("title", "author", "year")]
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *fields), F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"))
    return books.select("book_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["section"]), "\n")).alias("markdown"))
