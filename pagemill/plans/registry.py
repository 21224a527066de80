"""The named queries over the given tables and their SQL twins.

A document stands for a page: its source is the book, its language the author, its id the image. Its paragraphs end at single
line ends. Conversations stand for short books, whose turns are pages in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import fuzzy as Z
from pagemill.functions import text as X
from pagemill.operators import capture, catalog, chunking, contain, index, resolve, retrieval, vectors, works
from pagemill.plans import audit
from pagemill.plans.oracles import ORACLES
from pagemill.session import ensure_checkpoint_dir, shared_path, stored_table
from pagemill.sources import books
from pagemill.sources.tables import table

TOP = 20
PARAGRAPH = r"\n+"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit(".md")).alias("book_file"), F.col("source").alias("book_title"), F.col("lang").alias("author"), F.lit("").alias("year"), F.format_string("%d.jpeg", "doc_id").alias("image"), F.lit(None).cast("string").alias("page"), F.col("doc_id").alias("position"), "text")


def pages_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document, for the queries whose SQL twin has no folds."""
    return units(spark, sf_dir).withColumn("id", F.col("position"))


def document_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The stored index of the documents: made by the first query that asks, read by the others."""
    d = table(spark, sf_dir, "documents")
    return index.stored_index(d, "text", "lang", "source", key="doc_id")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark item: its whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _rounded(ranking: DataFrame) -> DataFrame:
    return ranking.select("query_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def lexical_topk(spark, sf_dir):
    return _rounded(retrieval.lexical(document_index(spark, sf_dir), probes(spark, sf_dir), TOP))


def coverage_topk(spark, sf_dir):
    return _rounded(retrieval.coverage(document_index(spark, sf_dir), probes(spark, sf_dir), TOP))


def fuzzy_topk(spark, sf_dir):
    return _rounded(retrieval.fuzzy(document_index(spark, sf_dir), probes(spark, sf_dir), TOP))


def rrf_fusion(spark, sf_dir):
    ix, asked = document_index(spark, sf_dir), probes(spark, sf_dir)
    both = retrieval.fused([retrieval.lexical(ix, asked, TOP), retrieval.coverage(ix, asked, TOP)])
    return both.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def term_stats(spark, sf_dir):
    return document_index(spark, sf_dir).terms.select("term", "df", "cf").where("cf >= 2")


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each benchmark item: that of the same number, as vectors stand for the documents of their numbers."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), "query_id")


def _with_vectors(spark: SparkSession, sf_dir: str, windows: DataFrame, number: Column) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("number"), F.col("embedding").alias("vec"))
    return windows.withColumn("number", number).join(held, "number", "left").drop("number")


def hybrid_search(spark, sf_dir):
    """Four channels (vectors, any term, all terms, near spellings), fused, re-scored by the stand-in scorer, diversified and cited."""
    chunks = stored_table(chunking.chunk_units(units(spark, sf_dir), PARAGRAPH).drop("embed_text", "content_sha"), "chunks")
    windows = _with_vectors(spark, sf_dir, chunking.chunk_windows(chunks, PARAGRAPH).select("id", "chunk_id"), F.regexp_extract("chunk_id", r"::([0-9]+)\.jpeg::", 1).cast("long"))
    ix, asked = index.build_index(chunks, "text", "author", "book_title"), probes(spark, sf_dir)
    best = retrieval.search(ix, chunks, windows, asked, _query_vectors(spark, sf_dir), scorer=retrieval.overlap_score, texts=lambda near: chunking.chunk_windows(near, PARAGRAPH))
    told = retrieval.results(best, chunks, asked)
    return told.select("query_id", "rank", F.bround("score", 4).alias("score"), "citation", "excerpt", "id")


def scoped_search(spark, sf_dir):
    """Vectors and both term channels within the books of a scope, fused; scores under a least one are left out."""
    chunks, asked = pages_as_chunks(spark, sf_dir), probes(spark, sf_dir)
    windows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    held, _ = retrieval.in_scope(chunks, "SRC1 fr")
    ids, ix = held.select("id"), document_index(spark, sf_dir)
    rankings = [retrieval.dense(windows, _query_vectors(spark, sf_dir), TOP, ids), retrieval.lexical(ix, asked, TOP, ids), retrieval.coverage(ix, asked, TOP, ids)]
    best = retrieval.fused(rankings).where(F.col("score") >= 0.016)
    return best.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


def _centroids(spark, sf_dir):
    """A query vector for each label: the mean of its vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    mean = rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return mean.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


def dense_topk(spark, sf_dir):
    hits = retrieval.dense_hits(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), TOP, key="vec_id", vector="embedding")
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def cells_topk(spark, sf_dir):
    """The same from an inverted file of the vectors, in its exact setting."""
    index_ = vectors.write_cells(table(spark, sf_dir, "embeddings"), shared_path(spark, "cells", fresh=True), key="vec_id", vector="embedding")
    hits = vectors.search(index_, _centroids(spark, sf_dir), TOP, probes=None)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_maxpool(spark, sf_dir):
    windows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("chunk_id"), F.col("embedding").alias("vec"))
    pooled = retrieval.dense(windows, _centroids(spark, sf_dir), TOP)
    return pooled.select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def recall_by_label(spark, sf_dir):
    hits = dense_topk(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("query_id"), F.col("rank"))).alias("first_rank"))
    return audit.recall_mrr(first)


def exact_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.format_string("%d.jpeg", "doc_id").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    found = resolve.exact_duplicates(files)
    return found.select("sha256", "canonical", F.array_join("dropped", ",").alias("dropped"), "n")


def duplicate_passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.substring("text", 1, 200).alias("passage")).agg(F.countDistinct("doc_id").alias("n")).where("n > 1")


def benchmark_containment(spark, sf_dir):
    """Documents that hold a benchmark text whole."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return contain.containment(table(spark, sf_dir, "documents"), items, "doc_id", "item_id")


def page_quality(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.read_quality(t).alias("q"), X.letters(t).alias("letters")).select("doc_id", "q.quality", "q.runaway", "letters")


def shot_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shot_type(F.col("text")).alias("type"))


def metadata_fields(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.isbn(t).alias("isbn"), X.year(t).alias("year"), X.publisher(t).alias("publisher"), X.call_number(t).alias("call_number"))


def running_headers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.running_header(F.col("text")).alias("header"), F.array_join(X.page_numbers(F.col("text")).cast("array<string>"), ",").alias("page_numbers"))


def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.markdown_to_text(F.col("text")).alias("plain"), X.normalized(F.col("text")).alias("normalized"))


def prompt_echo(spark, sf_dir):
    """Documents that hold a line of forty characters and more of any benchmark text, on a line of theirs or within one."""
    marks = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.lines(F.col("text"))).alias("passage")).where(F.length("passage") >= 40)
    return contain.containment(table(spark, sf_dir, "documents"), marks, "doc_id", "item_id").select("doc_id").distinct()


def capture_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"))
    return capture.capture_order(e, "user_id", "event_id", "ts").select("event_id", "user_id", F.col("capture_no").cast("long").alias("capture_no"))


def session_books(spark, sf_dir):
    e = capture.sessions(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")
    return e.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def session_windows(spark, sf_dir):
    """The same sessions by time alone, through Spark's session windows."""
    e = table(spark, sf_dir, "events")
    found = e.groupBy("user_id", F.session_window("ts", "21600 seconds")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select("user_id", "n", "first_ts", "last_ts")


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.format_string("book_%d.md", "conv_id").alias("book_file"), F.format_string("IMG_%04d.jpeg", "turn").alias("image"), F.col("turn").alias("position"), "role", "text")


def neighbour_pages(spark, sf_dir):
    """For each book the page after its system turn, with one page on either side."""
    turns = _turns(spark, sf_dir)
    hits = turns.where("role = 'user'").groupBy("book_file").agg(F.min("image").alias("image"))
    return catalog.neighbours(turns.select("book_file", "image"), hits, 1).select("book_file", "image", "hit")


def merge_tiny(spark, sf_dir):
    return chunking.merge_tiny(_turns(spark, sf_dir)).select("book_file", "position", "image", "text")


def book_round_trip(spark, sf_dir):
    """Turns written as book Markdown and parsed back into page units."""
    t = _turns(spark, sf_dir).select(F.col("book_file").alias("book_id"), F.col("book_file").alias("title"), F.lit("").alias("author"), F.lit("1999").alias("year"), "image", F.col("position").cast("string").alias("page"), "position", "text")
    written = books.book_markdown(t).select(F.col("book_id").alias("book_file"), F.col("markdown").alias("raw"))
    return books.parse_books(written).select("book_file", "book_title", "year", "image", "page", "text")


def group_shots(spark, sf_dir):
    """Conversations as rolls of shots: system turns are covers, the others pages."""
    t = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "system", "meta").otherwise("body")
    shots = t.select(
        F.col("conv_id").alias("roll"), F.format_string("IMG_%04d.jpeg", "turn").alias("image"), F.when(F.col("role") == "system", "COVER").otherwise("PAGE").alias("type"), role.alias("role"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 9000).cast("timestamp_ntz").alias("time"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.lit(None).cast("string").alias("cover_title"), F.lit("").alias("metadata"), F.col("text").alias("ocr_text"), F.col("text").alias("raw_md"), X.page_numbers(F.col("text")).alias("page_numbers"),
    )
    return capture.group_shots(shots)


def _library(spark, sf_dir):
    """Conversations as rolls of shots of a library, grouped into works."""
    t = table(spark, sf_dir, "conversations")
    reads = t.select(
        F.col("conv_id").alias("roll"), F.format_string("IMG_%d_%04d.jpeg", "conv_id", "turn").alias("image"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 100_000 + F.col("turn") * 60).cast("timestamp_ntz").alias("time"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("timestamp_ntz").alias("processed_at"), "text",
    )
    ensure_checkpoint_dir(spark)
    shots = works.healed(works.page_records(reads)).checkpoint()
    grouped = capture.group_shots(shots).select("roll", "image", "work", "work_title", "key_image", "title_counts")
    return shots.join(grouped, ["roll", "image"]).checkpoint()


def library_works(spark, sf_dir):
    """Every work of a library with its title, its host among works of one title or key, and its run of shots."""
    shots = _library(spark, sf_dir)
    titles = works.work_titles(shots).checkpoint()
    named = works.work_titles(shots, inferred=works.inferred_titles(shots, titles)).checkpoint()
    hosts = works.library_hosts(works.work_facts(shots, named).checkpoint()).checkpoint()
    summary = works.run_summary(works.assembled(shots, hosts))
    return named.join(hosts, "work").join(summary.select(F.col("work").alias("host"), "n_images", "yield_p50", "duration"), "host").select("work", "title", "host", "n_images", "yield_p50", "duration")


def work_records(spark, sf_dir):
    """Records of a library's works: title, bibliographic fields and where they come from."""
    shots = _library(spark, sf_dir)
    records = works.work_records(shots, works.work_titles(shots))
    return records.select("work", "title", F.to_json("fields").alias("fields"))


def split_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.split_long(F.coalesce("text", F.lit("")), paragraph=PARAGRAPH)).alias("part", "text"))


def window_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.split_windows(F.coalesce("text", F.lit("")), paragraph=PARAGRAPH)).alias("ord", "text"))


def books_listing(spark, sf_dir):
    return catalog.books_listing(units(spark, sf_dir))


def catalog_summary(spark, sf_dir):
    return catalog.catalog_summary(units(spark, sf_dir))


def scope_books(spark, sf_dir):
    return retrieval.scope_books(units(spark, sf_dir), "SRC1 fr")


def catalog_diff(spark, sf_dir):
    """An index run after which Spanish pages are new, French ones changed and German ones gone."""
    d = table(spark, sf_dir, "documents")
    sha = F.sha1(F.coalesce("text", F.lit("")))
    old = d.where("lang <> 'es'").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", F.lit("old")).otherwise(sha).alias("content_sha"))
    new = d.where("lang <> 'de'").select(F.col("doc_id").alias("id"), sha.alias("content_sha"))
    return catalog.catalog_diff(old, new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def coverage_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = X.shot_type(F.col("text"))
    role = F.when(kind.isin("COVER", "IMPRINT"), "meta").otherwise("body")
    shots = d.select("doc_id", "text", role.alias("role"))
    emitted = (F.col("role") == "body") | audit.recovered_body(F.col("role"), F.col("text")).isNotNull()
    reason = audit.coverage_reason(emitted, F.col("role"), F.col("text"))
    return audit.coverage_summary(shots.select(reason.alias("reason"), F.length("text").cast("long").alias("chars")))


def doctor_report(spark, sf_dir):
    """The health of a catalog whose windows are the documents, with the vectors of their numbers; German ones are of an older model."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    windows = d.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id", "left").select("text", "vec", F.when(F.col("lang") == "de", "old").otherwise("m").alias("vec_model"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 40).cast("string"), F.lit(".")).alias("book"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("page"))
    return audit.doctor(units(spark, sf_dir), windows, model="m", probes=asked, emitted_images=700)


def probe_candidates(spark, sf_dir):
    return audit.probe_candidates(pages_as_chunks(spark, sf_dir), document_index(spark, sf_dir).terms)


def probe_recall(spark, sf_dir):
    """Every book's own probe, asked of the any-term channel: recall and mean reciprocal rank."""
    chunks, ix = pages_as_chunks(spark, sf_dir), document_index(spark, sf_dir)
    asked = audit.probe_candidates(chunks, ix.terms).select(F.col("id").alias("query_id"), "query", F.col("book_file").alias("book"), F.format_string("%d.jpeg", "id").alias("image"), F.lit(None).cast("string").alias("page"))
    return audit.recall_mrr(audit.first_hits(retrieval.lexical(ix, asked, 5), asked, chunks))


def _page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), F.format_string("page_%d", "page_id").alias("work"), F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("title"))


def title_candidates(spark, sf_dir):
    works = _page_titles(spark, sf_dir).withColumn("isbn", F.lit("")).withColumn("call", F.lit(""))
    return resolve.title_candidates(works)


def bibliography_match(spark, sf_dir):
    """Page titles against a bibliography of the documents' first lines."""
    works = _page_titles(spark, sf_dir).select("work", F.lit("").alias("isbn"), F.array("title").alias("titles"))
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.lit("BOOK").alias("type"), F.get(X.full_lines(F.col("text")), F.lit(0)).alias("title"), F.lit("").alias("container"), F.lit("").alias("isbn"))
    return resolve.match_bibliography(works, entries)


def turn_similarity(spark, sf_dir):
    """How much each turn repeats the turn before it."""
    c = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    told = c.select("conv_id", "turn", X.normalized(F.col("text")).alias("now"), X.normalized(before).alias("before")).where("turn > 0")
    return told.select("conv_id", "turn", F.bround(Z.similarity(F.col("now"), F.col("before")), 4).alias("similarity"))


_QUERIES = (
    lexical_topk, coverage_topk, fuzzy_topk, rrf_fusion, term_stats, hybrid_search, scoped_search, dense_topk, cells_topk, dense_maxpool, recall_by_label, exact_dedup, duplicate_passages, benchmark_containment, page_quality, shot_types,
    metadata_fields, running_headers, plain_text, prompt_echo, capture_order, session_books, session_windows, neighbour_pages, merge_tiny, book_round_trip, group_shots, library_works, work_records, split_parts, window_parts,
    books_listing, catalog_summary, scope_books, catalog_diff, coverage_summary, doctor_report, probe_candidates, probe_recall, title_candidates, bibliography_match, turn_similarity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
