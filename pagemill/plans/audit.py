"""Coverage, catalog health and retrieval quality as ordinary queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import SPACES, is_echo, is_runaway, query_terms, strip

RECOVERED_LEAST = 400
GRAM = 4
TUNED_AT, SCALE_FACTOR, STALE_GROWTH, CHARS_A_TOKEN, TOKEN_CAP, DRIFT, DEPTH = 9500, 3, 0.25, 4.0, 512, 0.02, 5


def recovered_body(role: Column, text: Column, echo_marks: Sequence[str] = ()) -> Column:
    """Text of a cover or imprint that is long and sound enough to be kept as body; null otherwise."""
    body = strip(F.coalesce(text, F.lit("")))
    sound = (F.length(body) >= RECOVERED_LEAST) & ~is_echo(body, list(echo_marks)) & ~is_runaway(body)
    return F.when((role == "meta") & sound, body)


def coverage_reason(emitted: Column, role: Column, text: Column, echo_marks: Sequence[str] = ()) -> Column:
    """Why a shot's text is in no work; empty if it is in one."""
    body = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(emitted, "").when(F.length(body) < RECOVERED_LEAST, "thin-text").when(is_echo(body, list(echo_marks)), "prompt-echo-healed").when(is_runaway(body), "runaway-healed")
        .when(role == "meta", "meta-below-recovery-gate").when(role == "skip", "skipped").otherwise("UNEXPLAINED")
    )


def coverage_summary(shots: DataFrame) -> DataFrame:
    """(reason, n, chars) of shots (reason, chars), the most frequent first; those in a work count as emitted."""
    reason = F.when(F.col("reason") == "", "emitted").otherwise(F.col("reason"))
    return shots.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).orderBy(F.desc("n"), "reason")


def not_emitted(shots: DataFrame) -> DataFrame:
    """(image, type, role, reason, chars) of the shots (reason, chars and those) that are in no work."""
    return shots.where("reason <> ''").select("image", "type", "role", "reason", "chars")


def _check(rows: DataFrame, name: str, bad: Column, message: Column, level: str = "WARN") -> DataFrame:
    return rows.select(F.when(bad, level).otherwise("OK").alias("level"), F.lit(name).alias("name"), message.alias("message"))


def doctor(chunks: DataFrame, windows: DataFrame, model: str | None = None, probes: DataFrame | None = None, history: DataFrame | None = None, emitted_images: int | None = None) -> DataFrame:
    """(level, name, message): one row for each health check of a catalog."""
    n = F.count(F.lit(1))
    text = lambda c: c.cast("string")
    out = [
        _check(chunks.agg(n.alias("n"), F.countDistinct("book_file").alias("b")), "corpus", F.col("n") == 0, F.concat(text(F.col("n")), F.lit(" chunks, "), text(F.col("b")), F.lit(" books"))),
        _check(chunks.where(~F.lower("image").rlike(r"\.(jpe?g|png|tiff?|heic)$")).agg(n.alias("n")), "uncitable-labels", F.col("n") > 0, text(F.col("n"))),
        _check(windows.agg(n.alias("n"), F.count("vec").alias("v"), F.count(F.when(F.col("vec_model") != F.lit(model), 1)).alias("s")), "vectors", (F.col("v") < F.col("n")) | (F.col("s") > 0), F.concat(text(F.col("n") - F.col("v")), F.lit(" without, "), text(F.col("s")), F.lit(" of another model"))),
        _check(windows.where(F.length("text") > CHARS_A_TOKEN * TOKEN_CAP).agg(n.alias("n")), "truncation", F.col("n") > 0, text(F.col("n"))),
        _check(chunks.agg(n.alias("n")), "scale", F.col("n") > SCALE_FACTOR * TUNED_AT, text(F.col("n"))),
    ]
    head = F.substring("text", 1, 200)
    twice = chunks.select("image", head.alias("head")).groupBy("head").agg(F.countDistinct("image").alias("images")).where("images > 1")
    out.append(_check(twice.agg(n.alias("n")), "duplicates", F.col("n") > 0, text(F.col("n")), level="INFO"))
    if probes is not None:
        out.append(_check(dead_probes(chunks, probes).agg(n.alias("n")), "probes", F.col("n") > 0, text(F.col("n"))))
    if history is not None:
        last = history.agg(F.max_by("chunks", "at").alias("then")).crossJoin(chunks.agg(n.alias("n")))
        out.append(_check(last, "eval-staleness", F.coalesce(F.col("n") > (1 + STALE_GROWTH) * F.col("then"), F.lit(True)), F.concat(text(F.col("n")), F.lit(" chunks, then "), F.coalesce(text(F.col("then")), F.lit("none")))))
    if emitted_images is not None:
        had = chunks.agg(F.countDistinct("image").alias("n"))
        out.append(_check(had, "ocr-rag-gap", F.abs(F.col("n") - emitted_images) > F.greatest(F.lit(5.0), F.lit(0.02 * emitted_images)), F.concat(text(F.col("n")), F.lit(f" of {emitted_images}"))))
    report = out[0]
    for check in out[1:]:
        report = report.unionByName(check)
    return report


def empty_books(books: DataFrame, chunks: DataFrame) -> DataFrame:
    return books.select("book_file").distinct().join(chunks, "book_file", "left_anti")


def probe_matches(probe_book: Column, probe_image: Column, probe_page: Column, book_file: Column, image: Column, page: Column) -> Column:
    """A row satisfies a probe if the parts that the probe names agree: book by substring, image by its start, page exactly."""
    book = probe_book.isNull() | F.lower(book_file).contains(F.lower(probe_book))
    return book & (probe_image.isNull() | image.startswith(probe_image)) & (probe_page.isNull() | (F.coalesce(page, F.lit("")) == probe_page))


def dead_probes(chunks: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (query_id, query, book, image, page) that no chunk satisfies. Probes find their books by the characters that both hold, and
    meet chunks by an equal book and image start; those that name no book meet chunks by their image or page."""
    places = chunks.select("book_file", "image", F.coalesce("page", F.lit("")).alias("place")).distinct()
    books = places.select("book_file").distinct()
    asked = probes.where("book is not null or image is not null or page is not null")
    seen = places.withColumnRenamed("image", "seen")
    fits = (F.col("image").isNull() | F.col("seen").startswith(F.col("image"))) & (F.col("page").isNull() | (F.col("place") == F.col("page")))
    # A name part of `k` characters, up to GRAM, is a gram of every book name that holds it.
    part = F.lower("book")
    size = F.least(F.length(part), F.lit(GRAM))
    keyed = asked.where("book <> ''").withColumns({"gram": F.substring(part, F.lit(1), size), "part": part})
    low = F.lower("book_file")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - k + 1, F.lit(1))), lambda i: F.substring(low, i, k)))))
    named = keyed.join(books.select("book_file", F.explode(grams).alias("gram")), "gram").where(F.lower("book_file").contains(F.col("part"))).join(seen, "book_file").where(fits).select("query_id")
    # The first characters of an image are a key in the same way; a probe that names a page alone meets it by an equal page.
    free = asked.where("book is null or book = ''")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(GRAM * 2)), lambda k: F.substring("seen", F.lit(1), k)))
    by_image = free.where("image <> ''").withColumn("start", F.substring("image", F.lit(1), F.least(F.length("image"), F.lit(GRAM * 2))))
    imaged = by_image.join(seen.select("seen", "place", F.explode(starts).alias("start")), "start").where(fits).select("query_id")
    paged = free.where("coalesce(image, '') = '' and page is not null").join(places.select(F.col("place").alias("page")).distinct(), "page").select("query_id")
    # An empty name part is in every book, an empty image is the start of every one.
    any_ = free.where("coalesce(image, '') = '' and page is null").where(F.lit(not places.isEmpty())).select("query_id")
    met = named.unionByName(imaged).unionByName(paged).unionByName(any_)
    return asked.join(met.select("query_id").distinct(), "query_id", "left_anti")


def first_hits(ranking: DataFrame, probes: DataFrame, chunks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, first_rank): the best rank, within `depth`, of a chunk that satisfies each probe; null for none."""
    met = ranking.where(F.col("rank") <= depth).join(chunks.select("id", "book_file", "image", F.col("page").alias("chunk_page")), "id").join(probes.select("query_id", "book", F.col("image").alias("probe_image"), F.col("page").alias("probe_page")), "query_id")
    hit = probe_matches(F.col("book"), F.col("probe_image"), F.col("probe_page"), F.col("book_file"), F.col("image"), F.col("chunk_page"))
    best = met.where(hit).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return probes.select("query_id").join(best, "query_id", "left")


def recall_mrr(hits: DataFrame) -> DataFrame:
    """One row: recall at 1, 3 and 5, and the mean reciprocal rank of first hits (first_rank)."""
    at = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    return hits.agg(F.count(F.lit(1)).alias("probes"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def drift(history: DataFrame) -> DataFrame:
    """Runs (at, mode, mrr) with the change since the run before, and whether it fell by over 0.02."""
    change = F.col("mrr") - F.lag("mrr").over(W.partitionBy("mode").orderBy("at"))
    return history.withColumn("change", F.bround(change, 6)).withColumn("fell", F.coalesce(F.col("change") < -DRIFT, F.lit(False)))


def probe_candidates(chunks: DataFrame, terms: DataFrame, least: int = 600, most: int = 160) -> DataFrame:
    """(book_file, id, query): for each book the sentence of its first long chunk of a photographed page whose words are rarest on average, with
    single spaces, cut to `most` characters."""
    first = chunks.where((F.length("text") > least) & F.lower("image").endswith(".jpeg")).groupBy("book_file").agg(F.min_by(F.struct("id", "text"), "id").alias("c")).select("book_file", "c.id", "c.text")
    sentences = first.select("book_file", "id", F.posexplode(F.split("text", rf"(?<=[.!?]){SPACES}+")).alias("no", "sentence")).withColumn("terms", query_terms(F.col("sentence"))).where("size(terms) between 6 and 25")
    words = sentences.select("book_file", "id", "no", "sentence", F.explode("terms").alias("term")).join(terms.select("term", "cf"), "term", "left")
    scored = words.groupBy("book_file", "id", "no", "sentence").agg(F.avg(1 / (1 + F.coalesce("cf", F.lit(0)))).alias("rare"))
    best = scored.groupBy("book_file", "id").agg(F.max_by("sentence", F.struct(F.round("rare", 9), -F.col("no"))).alias("sentence"))
    return best.select("book_file", "id", F.substring(strip(F.regexp_replace("sentence", rf"{SPACES}+", " ")), 1, most).alias("query"))


def history_row(recalls: DataFrame, chunks: DataFrame, at: str, mode: str, embed_model: str | None = None, rerank_model: str | None = None) -> DataFrame:
    """A row for the history of evaluations: recalls (`recall_mrr`) of a mode with the size of the catalog they hold for."""
    size = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("book_file").alias("books"))
    told = recalls.select(F.lit(at).alias("at"), F.lit(mode).alias("mode"), "probes", F.lit(embed_model).cast("string").alias("embed_model"), F.lit(rerank_model).cast("string").alias("rerank_model"), *[F.round(c, 3).alias(c) for c in ("r1", "r3", "r5", "mrr")])
    return told.crossJoin(size)


def score_table(scores: DataFrame) -> DataFrame:
    """(model, fixture, ..., mean): scores (model, fixture, score) side by side, a column a fixture; the mean is of those there are."""
    return scores.groupBy("model").pivot("fixture").agg(F.round(F.first("score"), 3)).join(scores.groupBy("model").agg(F.round(F.avg("score"), 3).alias("mean")), "model")
