"""Works of grouped shots: their titles, what belongs together across a library, and their records.

Rows are shots with the columns of PAGE_RECORD and those of `capture.group_shots` (work, capture_no, key_image,
title_counts); a work is called by its first shot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import titles as T
from pagemill.functions.fuzzy import TITLE_RATIO, same_title, title_pairs, titles_match
from pagemill.operators import resolve

#: Shots whose running title must agree before it overrules a cover.
OVERRULING = 3
UNTITLED = "Untitled ("
META, COVER = "coalesce(role = 'meta', false)", "coalesce(type = 'COVER', false)"


def _stem(image: Column) -> Column:
    return F.regexp_replace(image, r"\.[^.]*$", "")


def _order() -> Column:
    return F.struct(F.col("time").isNotNull(), "time", "image")


def told_titles(shots: DataFrame) -> DataFrame:
    """(work, rung, at, title): every title that a shot offers its work, the surest rung first: 1 a cover's, 2 one of metadata,
    3 cataloguing data, 4 a running title; and `header`, what the shot counts for in the vote of running titles."""
    counts = F.coalesce("title_counts", F.lit(True))
    named = F.when(counts, T.field(F.col("metadata"), "title"))
    sound = X.let(named, lambda x: F.when(~x.rlike(X.FOLIO), x))
    cover = F.coalesce(F.nullif(X.strip(F.col("cover_title")), F.lit("")), sound, T.cover_text_title(F.col("ocr_text")))
    header = F.nullif(T.shot_title(F.col("role"), F.col("type"), F.col("cover_title"), F.when(counts, F.col("metadata")), F.col("ocr_text"), F.col("raw_md")), F.lit(""))
    meta = F.expr(META)
    offers = F.array(
        F.struct(F.lit(1).alias("rung"), F.when(meta & F.expr(COVER), cover).alias("title")), F.struct(F.lit(2).alias("rung"), F.when(meta, sound).alias("title")),
        F.struct(F.lit(3).alias("rung"), F.when(meta, T.catalogued_title(F.col("ocr_text"))).alias("title")), F.struct(F.lit(4).alias("rung"), header.alias("title")),
    )
    return shots.select("work", _order().alias("at"), F.explode(offers).alias("o")).select("work", "at", "o.rung", "o.title").where("title is not null")


def work_titles(shots: DataFrame, overrides: DataFrame | None = None, inferred: DataFrame | None = None) -> DataFrame:
    """(work, title): what a hand says (stem, title), else the surest title that is one. A cover is overruled by a running title
    that `OVERRULING` shots agree on, if that differs and is no line of names; running titles go by votes, first seen on ties;
    then come titles inferred (work, title) from spines, and a name by the first shot that is no key image."""
    told = told_titles(shots)
    votes = told.where("rung = 4").groupBy("work", "title").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    leading = votes.groupBy("work").agg(F.min_by(F.struct("title", "n"), F.struct(-F.col("n"), "at")).alias("top"))
    ranked = votes.select("work", F.lit(4).alias("rung"), (-F.col("n")).alias("votes"), "at", "title")
    rest = told.where("rung < 4").select("work", "rung", F.lit(0).cast("long").alias("votes"), "at", "title")
    offers = rest.unionByName(ranked).where(~resolve.no_title(F.col("title")))
    best = offers.groupBy("work").agg(F.min_by(F.struct("rung", "title"), F.struct("rung", "votes", "at")).alias("best")).join(leading, "work", "left")
    overruled = (F.col("best.rung") == 1) & (F.col("top.n") >= OVERRULING) & ~same_title(X.normalized(F.col("best.title")), X.normalized(F.coalesce("top.title", F.lit("")))) & ~T.looks_like_names(F.col("top.title"))
    chosen = best.select("work", F.when(F.coalesce(overruled, F.lit(False)), F.col("top.title")).otherwise(F.col("best.title")).alias("told"))
    first = shots.groupBy("work").agg(F.coalesce(F.min_by("image", F.when(~F.coalesce("key_image", F.lit(False)), _order())), F.min_by("image", _order())).alias("first"))
    out = first.join(chosen, "work", "left")
    for name, table in (("by_hand", overrides), ("inferred", inferred)):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        elif name == "by_hand":
            hand = shots.select("work", _stem(F.col("image")).alias("stem"), _order().alias("at")).join(table, "stem").groupBy("work").agg(F.min_by("title", "at").alias(name))
            out = out.join(hand, "work", "left")
        else:
            out = out.join(table.select("work", F.col("title").alias(name)), "work", "left")
    return out.select("work", F.coalesce("by_hand", "told", "inferred", F.concat(F.lit(UNTITLED), _stem(F.col("first")), F.lit(")"))).alias("title"))


def inferred_titles(shots: DataFrame, titles: DataFrame) -> DataFrame:
    """(work, title) of untitled works with a key image of spines: the first title on a spine that is none of the known works'."""
    known = titles.where(~F.startswith("title", F.lit(UNTITLED))).select(X.normalized(F.col("title")).alias("title"))
    lost = titles.where(F.startswith("title", F.lit(UNTITLED))).select("work")
    spines = shots.where("key_image").join(lost, "work", "left_semi").select("work", _order().alias("at"), F.posexplode(T.spine_titles(F.col("ocr_text"))).alias("spine", "names"))
    named = spines.select("work", "at", "spine", F.posexplode("names").alias("no", "name"))
    met = title_pairs(named.select(X.normalized(F.col("name")).alias("title")), known, TITLE_RATIO, titles_match).select(F.col("a").alias("low")).distinct()
    judged = named.withColumn("low", X.normalized(F.col("name"))).join(met.withColumn("met", F.lit(True)), "low", "left")
    free = judged.groupBy("work", "at", "spine").agg(F.max(F.coalesce("met", F.lit(False))).alias("met"), F.min_by("name", "no").alias("name")).where("not met")
    return free.groupBy("work").agg(F.min_by("name", F.struct("at", "spine")).alias("title"))


def work_facts(shots: DataFrame, titles: DataFrame) -> DataFrame:
    """(work, position, title, name, isbn, call, has_body, has_meta) of every work; position is the order of first shots."""
    isbn = F.regexp_replace(T.field(F.col("metadata"), "isbn"), "[^0-9Xx]", "")
    call = X.call_number(F.col("ocr_text"))
    body = F.expr("coalesce(role = 'body', false)") & (X.strip(F.coalesce("raw_md", F.lit(""))) != "")
    told = shots.groupBy("work").agg(
        F.min(_order()).alias("at"), F.first("work_title", True).alias("name"), F.coalesce(F.min_by(isbn, F.when(isbn != "", _order())), F.lit("")).alias("isbn"),
        F.coalesce(F.min_by(call, F.when(call != "", _order())), F.lit("")).alias("call"), F.max(body).alias("has_body"), F.max(F.expr(META)).alias("has_meta"),
    )
    return told.join(titles, "work").withColumn("position", F.struct("at", "work")).drop("at")


def library_hosts(works: DataFrame) -> DataFrame:
    """(work, host) of `work_facts`: what is the same work across a library.

    First works of covers alone go to the first work with text that has their title or name, if that is one they may be named by;
    then works with text go to the first with the same ISBN or, failing one, call number. Works that differ in these stay apart.
    """
    lone = works.where("has_meta and not has_body").where(T.confident(F.col("title"))).select("work", X.normalized(F.col("title")).alias("a"))
    bodies = works.where("has_body")
    named = bodies.select("work", "position", F.explode(F.array_distinct(F.array(X.normalized(F.col("title")), X.normalized(F.coalesce("name", "title"))))).alias("b"))
    alike = title_pairs(lone.select(F.col("a").alias("title")), named.select(F.col("b").alias("title")), TITLE_RATIO, titles_match)
    covers = lone.join(alike, "a").join(named.select(F.col("work").alias("host"), "position", "b"), "b").groupBy("work").agg(F.min_by("host", "position").alias("host"))
    # A cover brings its ISBN and call number along, behind those of its host.
    brought = covers.join(works.select("work", "isbn", "call", "position"), "work").groupBy("host").agg(*[F.min_by(c, F.when(F.col(c) != "", F.col("position"))).alias(f"more_{c}") for c in ("isbn", "call")])
    keyed = bodies.join(brought, bodies.work == brought.host, "left").select("work", "position", *[F.coalesce(F.nullif(c, F.lit("")), f"more_{c}", F.lit("")).alias(c) for c in ("isbn", "call")])
    hosts = resolve.strong_key_hosts(keyed).select("work", "host")
    through = covers.select("work", F.col("host").alias("body")).join(hosts.select(F.col("work").alias("body"), "host"), "body").select("work", "host")
    rest = works.select("work").join(hosts.unionByName(through), "work", "left")
    return rest.select("work", F.coalesce("host", "work").alias("host"))


def assembled(shots: DataFrame, hosts: DataFrame) -> DataFrame:
    """The shots with their host for a work, in order of time and name within it, and `seeds`, the works it was made of."""
    joined = shots.join(hosts, "work").withColumnRenamed("work", "seed").withColumnRenamed("host", "work")
    place = F.row_number().over(W.partitionBy("work").orderBy(F.col("time").asc_nulls_first(), "image"))
    seeds = joined.groupBy("work").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    return joined.withColumn("capture_no", place).join(seeds, "work")


def work_records(shots: DataFrame, titles: DataFrame, matches: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(work, title, fields, note): a bibliography entry's title and fields where one matches (work, position), else those of the shots.
    Editors stand for authors where there are none; the note is null without a bibliography."""
    blocks = shots.where(META).groupBy("work").agg(F.transform(F.array_sort(F.collect_list(F.struct(_order().alias("at"), "metadata"))), lambda s: s["metadata"]).alias("blocks"))
    calls = shots.groupBy("work").agg(F.min_by(X.call_number(F.col("ocr_text")), F.when(X.call_number(F.col("ocr_text")) != "", _order())).alias("call"))
    own = titles.join(blocks, "work", "left").join(calls, "work", "left").withColumn("own", T.bibliographic_fields(F.coalesce("blocks", F.array().cast("array<string>")), F.col("call")))
    if matches is None or entries is None:
        return own.select("work", "title", F.col("own").alias("fields"), F.lit(None).cast("string").alias("note"))
    edited = F.concat(F.array_join("editors", "; "), F.when(F.size("editors") > 1, " (eds.)").otherwise(" (ed.)"))
    people = F.when(F.size("authors") > 0, F.array_join("authors", "; ")).when(F.size("editors") > 0, edited)
    listed = matches.select("work", "position").join(entries.select("position", F.col("title").alias("listed"), people.alias("author"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("publisher", "year", "isbn", "city")]), "position").drop("position")
    joined = own.join(listed, "work", "left")
    given = F.map_filter(F.create_map(*[x for n in ("author", "publisher", "year", "isbn", "city") for x in (F.lit(n), F.col(n))], F.lit("call_number"), F.nullif(F.col("call"), F.lit(""))), lambda k, v: v.isNotNull())
    there = F.col("listed").isNotNull()
    note = F.when(there, F.concat(F.lit("Matched to “"), F.col("listed"), F.lit("”"))).otherwise(F.lit("No match — title and fields from the shots only"))
    return joined.select("work", F.coalesce("listed", "title").alias("title"), F.when(there, given).otherwise(F.col("own")).alias("fields"), note.alias("note"))


def run_summary(shots: DataFrame) -> DataFrame:
    """(work, n_images, latest_run, yield_p50, first_time, last_time, duration): how many images, when they were last read, the upper median
    of letters read, and the span of capture."""
    scores = F.array_sort(F.collect_list("text_score"))
    middle = lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int"))
    told = shots.groupBy("work").agg(F.count(F.lit(1)).alias("n_images"), F.max("processed_at").alias("latest_run"), scores.alias("scores"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    seconds = F.unix_timestamp(F.col("last_time").cast("timestamp")) - F.unix_timestamp(F.col("first_time").cast("timestamp"))
    return told.select("work", "n_images", "latest_run", middle(F.col("scores")).alias("yield_p50"), "first_time", "last_time", X.duration(seconds).alias("duration"))


def healed(shots: DataFrame, echo: Column | None = None) -> DataFrame:
    """Body shots whose text is a runaway or an echo of instructions, blanked before anything is made of them."""
    bad = F.expr("coalesce(role = 'body', false)") & (X.is_runaway(F.col("raw_md")) | (F.lit(False) if echo is None else echo))
    return shots.withColumns({"raw_md": F.when(bad, "").otherwise(F.col("raw_md")), "running_header": F.when(bad, "").otherwise(F.col("running_header")), "page_numbers": F.when(bad, F.array().cast("array<int>")).otherwise(F.col("page_numbers"))})


def page_records(reads: DataFrame, echo: Column | None = None) -> DataFrame:
    """Records of reads (image, text, and where known colourfulness, boxes of a layout): type, role, figures, texts, cover title, metadata,
    running header and page numbers, as PAGE_RECORD names them."""
    text = F.coalesce("text", F.lit(""))
    known = set(reads.columns)
    kind = X.shot_type(text, F.col("colourfulness") if "colourfulness" in known else None)
    boxes = F.col("boxes") if "boxes" in known else F.lit(None).cast(T.BOXES)
    sorted_ = reads.withColumn("type", kind).withColumn("role", F.when(F.col("type").isin("COVER", "IMPRINT"), "meta").otherwise("body"))
    body = F.col("role") == "body"
    marked = sorted_.withColumn("figures", F.when(body & (T.figure_regions(boxes) > 0), T.figure_captions(text)).otherwise(F.array().cast("array<string>")))
    told = marked.withColumn("ocr_text", F.when(F.size("figures") > 0, T.with_figure_marks(text, F.col("figures"))).otherwise(text))
    sound = body & ~(F.lit(False) if echo is None else echo)
    cover = F.col("cover_title")
    told = told.withColumn("cover_title", F.when(F.col("type") == "COVER", T.cover_title_of(boxes)).otherwise(""))
    return told.select(
        *[c for c in reads.columns if c not in ("text", "boxes", "colourfulness")], "type", "role", "figures", X.letters(text).cast("int").alias("text_score"), X.text_quality(text).alias("quality"),
        F.when(sound, F.col("ocr_text")).otherwise("").alias("raw_md"), "ocr_text", "cover_title",
        F.when(~body, X.metadata_block(text, F.coalesce(F.nullif(cover, F.lit("")), F.when(F.col("type") == "COVER", T.cover_text_title(text))))).otherwise("").alias("metadata"),
        F.when(sound, X.running_header(F.col("ocr_text"))).otherwise("").alias("running_header"), F.when(sound, X.page_numbers(F.col("ocr_text"))).otherwise(F.array().cast("array<int>")).alias("page_numbers"),
    )
