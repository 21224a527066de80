"""Titles of works, what is one work across a library, records; passages held whole; the catalog and searches over it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import catalog, contain, index, retrieval, works
from pagemill.plans import audit
from pagemill.sources import books
from pagemill.streaming import ingest

T0 = dt.datetime(2024, 5, 1, 9)
SHOT = "work string, work_title string, image string, time timestamp_ntz, role string, type string, cover_title string, metadata string, ocr_text string, raw_md string, key_image boolean, title_counts boolean, text_score int, processed_at timestamp_ntz"
BODY = "long body text that is no title because it runs on and on past the length that a title may have"


def shot(work, n, text="", kind="PAGE", title=None, metadata="", name=None, key=False, counts=True):
    role = "meta" if kind in ("COVER", "IMPRINT") else "body"
    return (work, name, f"IMG_{n:03d}.jpeg", T0 + dt.timedelta(minutes=n), role, kind, title, metadata, text, text if role == "body" else "", key, counts, 10 * n, T0 + dt.timedelta(days=n))


def told(spark, *shots):
    return spark.createDataFrame(list(shots), SHOT)


def titles_of(frame):
    return {r["work"]: r["title"] for r in frame.collect()}


def test_the_ladder_of_titles(spark):
    head = lambda t: f"{t}\n{BODY}"
    shots = told(
        spark,
        shot("a", 1, kind="COVER", title="Preface"), shot("a", 2, kind="COVER", title="Alpha Harbour"), shot("a", 3, head("Beta Roads")),
        shot("b", 11, kind="COVER", title="Ui Shot"), *[shot("b", 12 + i, head("Rivers of the North")) for i in range(3)],
        shot("c", 21, kind="COVER", title="Delta Lakes"), *[shot("c", 22 + i, head("Denis Wood")) for i in range(3)],
        shot("d", 31, kind="IMPRINT", metadata="title: Epsilon"), shot("d", 32, head("Zeta")),
        shot("e", 41, "Cataloguing-in-Publication data\n\neta towns / X", kind="IMPRINT"), shot("f", 51, head("Theta")), shot("f", 52, head("Iota")), shot("f", 53, head("Iota")),
        shot("g", 61, BODY, key=True), shot("g", 62, BODY), shot("h", 71, kind="COVER", metadata="title: plate of shells", counts=False), shot("h", 72, head("Kappa Bay")),
    )
    assert titles_of(works.work_titles(shots)) == {"a": "Alpha Harbour", "b": "Rivers of the North", "c": "Delta Lakes", "d": "Epsilon", "e": "Eta towns", "f": "Iota", "g": "Untitled (IMG_062)", "h": "Kappa Bay"}
    by_hand = spark.createDataFrame([("IMG_003", "By Hand")], "stem string, title string")
    inferred = spark.createDataFrame([("g", "Seen on a Spine"), ("a", "no")], "work string, title string")
    assert {w: t for w, t in titles_of(works.work_titles(shots, by_hand, inferred)).items() if w in "ag"} == {"a": "By Hand", "g": "Seen on a Spine"}


def test_titles_from_spines_by_exclusion(spark):
    shelf = "Wag 1\nUser Group:\nAlpha Harbour\nWag 2\nUser Group:\nIron Roads\nWag 3\nUser Group:\nLater Book"
    shots = told(spark, shot("a", 1, kind="COVER", title="Alpha Harbor"), shot("b", 11, shelf, key=True), shot("b", 12, BODY))
    assert titles_of(works.inferred_titles(shots, works.work_titles(shots))) == {"b": "Iron Roads"}


def test_library_hosts_and_order(spark):
    shots = told(
        spark,
        shot("late cover", 90, kind="COVER", title="Alpha Harbours", metadata="isbn: 978-1"), shot("a", 1, f"Alpha Harbour\n{BODY}"), shot("b", 20, f"Beta Roads\n{BODY}"), shot("b", 21, kind="IMPRINT", metadata="isbn: 9781"),
        shot("c", 30, f"N305.1/18\n{BODY}"), shot("d", 40, f"N305.1/18\n{BODY}"), shot("e", 50, f"N306.1/18\n{BODY}"), shot("shells", 60, kind="COVER", title="plate of alpha harbour"),
    )
    facts = works.work_facts(shots, works.work_titles(shots))
    hosts = {r["work"]: r["host"] for r in works.library_hosts(facts).collect()}
    assert hosts == {"late cover": "a", "a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "shells": "shells"}
    joined = works.assembled(shots, spark.createDataFrame(list(hosts.items()), "work string, host string"))
    assert [r["image"] for r in joined.where("work = 'a'").orderBy("capture_no").collect()] == ["IMG_001.jpeg", "IMG_020.jpeg", "IMG_021.jpeg", "IMG_090.jpeg"] and joined.where("work = 'a'").first()["seeds"] == ["a", "b", "late cover"]
    run = {r["work"]: r for r in works.run_summary(joined).collect()}["a"]
    assert (run["n_images"], run["yield_p50"], run["duration"], run["latest_run"]) == (4, 210, "1 h 29 min", T0 + dt.timedelta(days=90))


def test_work_records(spark):
    shots = told(spark, shot("a", 1, kind="COVER", title="The Long Sea", metadata="publisher: P\nyear: 1990"), shot("a", 2, f"N1234/5\n{BODY}"), shot("b", 3, f"Other\n{BODY}"))
    titles = works.work_titles(shots)
    own = {r["work"]: (r["title"], r["fields"], r["note"]) for r in works.work_records(shots, titles).collect()}
    assert own["a"] == ("The Long Sea", {"publisher": "P", "year": "1990", "call_number": "N1234/5"}, None)
    entries = spark.createDataFrame([(7, "The Long Sea: A History", [], ["A. Ed", "B. Ed"], "Q", "", "12", "")], "position int, title string, authors array<string>, editors array<string>, publisher string, year string, isbn string, city string")
    both = {r["work"]: (r["title"], r["fields"], r["note"]) for r in works.work_records(shots, titles, spark.createDataFrame([("a", 7)], "work string, position int"), entries).collect()}
    assert both["a"] == ("The Long Sea: A History", {"author": "A. Ed; B. Ed (eds.)", "publisher": "Q", "isbn": "12", "call_number": "N1234/5"}, "Matched to “The Long Sea: A History”") and both["b"][2].startswith("No match")


def test_page_records_and_healing(spark):
    boxes = [("Picture", [0.0, 0.0, 9.0, 9.0], None)]
    reads = spark.createDataFrame([("a.jpeg", f"12\nFig. 2 A map\n{BODY * 5}", boxes), ("b.jpeg", "THE LONG SEA", None), ("c.jpeg", None, None), ("d.jpeg", "loop\n" * 300, None)], "image string, text string, boxes array<struct<category: string, bbox: array<double>, text: string>>")
    got = {r["image"]: r for r in works.healed(works.page_records(reads)).collect()}
    assert got["a.jpeg"]["figures"] == ["Fig. 2 A map"] and "> **[Figure — Fig. 2 A map]**" in got["a.jpeg"]["raw_md"] and got["a.jpeg"]["page_numbers"] == [12]
    assert (got["b.jpeg"]["role"], got["b.jpeg"]["metadata"], got["b.jpeg"]["raw_md"]) == ("meta", "title: THE LONG SEA", "") and got["c.jpeg"]["type"] == "COVER"
    assert got["d.jpeg"]["role"] == "body" and got["d.jpeg"]["raw_md"] == "" and got["d.jpeg"]["ocr_text"].startswith("loop")


def test_passages_against_plain_containment(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "bb", "c,", "d.", "ee", "(f", "g"])
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, ""]
    passages = [t[i : i + n] for t in texts[:40] for i, n in ((rnd.randint(0, 20), rnd.randint(1, 40)),)] + ["", "zz", "a  bb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if t and p and p in t}
    # By one automaton, and by keys with several automata of short passages.
    for most in (contain.MOST_CHARS, 12):
        found = contain.containment(docs, asked, "doc_id", "item_id", most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    assert contain.containment(docs, asked.where("false"), "doc_id", "item_id").collect() == []


def test_ten_thousand_passages_in_one_plan(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(300)]
    passages = [*words, *(f"{a} {b}" for a in words[:100] for b in words[:90]), *(" ".join(rnd.choices(words, k=3)) for _ in range(600))]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if p in t}
    assert {(r["doc_id"], r["item_id"]) for r in contain.containment(docs, asked, "doc_id", "item_id").collect()} == want


def test_index_runs_and_versions(spark, tmp_path):
    chunks = lambda *rows: spark.createDataFrame(list(rows), "id string, content_sha string, text string")
    windows = lambda *ids: spark.createDataFrame([(f"{i}::w0", i, 0, f"text {i}", "s") for i in ids], "id string, chunk_id string, ord int, text string, content_sha string")
    path = str(tmp_path / "catalog")
    assert catalog.open_catalog(spark, path) is None
    first = catalog.index_run(None, chunks(("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")), windows("a", "b", "c"))
    first.windows = catalog.embedded(first.windows, lambda t: F.array(F.length(t).cast("float")), "m")
    catalog.write_catalog(first, path)
    old = catalog.open_catalog(spark, path)
    new = chunks(("a", "1", "x"), ("b", "9", "y2"), ("d", "4", "w"))
    assert tuple(catalog.run_counts(old, new).first()) == (2, 1, 1) and tuple(catalog.run_counts(None, new).first()) == (3, 0, 0)
    second = catalog.index_run(old, new, windows("a", "b", "d"))
    assert {r["chunk_id"]: r["vec"] for r in second.windows.collect()} == {"a": [6.0], "b": None, "d": None} and catalog.pending(second.windows, "m").count() == 2
    catalog.write_catalog(second, path)
    last = catalog.open_catalog(spark, path)
    assert {tuple(r) for r in last.chunks.collect()} == {tuple(r) for r in second.chunks.collect()} and {r["id"]: r["vec"] for r in last.windows.collect()} == {r["id"]: r["vec"] for r in second.windows.collect()}
    # Chunk a is as it was, so the new version points to the file of the old one; nothing at all is written for a catalog without changes.
    where = {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/version=2/manifest").where("name = 'chunks'").collect()}
    at = {r["id"]: r["bucket"] for r in last.chunks.select("id", F.pmod(F.xxhash64("id"), F.lit(catalog.BUCKETS)).cast("int").alias("bucket")).collect()}
    assert where[at["a"]] == 1 and where[at["b"]] == where[at["d"]] == 2
    catalog.write_catalog(last, path)
    assert not (tmp_path / "catalog/version=3/chunks").exists() and not (tmp_path / "catalog/version=3/windows").exists()
    assert {r["id"] for r in catalog.open_catalog(spark, path).windows.collect()} == {r["id"] for r in second.windows.collect()}
    # A run that breaks off before it names its version leaves the one before.
    last.chunks.where("id = 'a'").write.parquet(f"{path}/version=4/chunks")
    assert catalog.open_catalog(spark, path).chunks.count() == 3
    empty = catalog.index_run(None, chunks(("a", "1", "x")).where("false"), windows("a").where("false"))
    catalog.write_catalog(empty, path)
    assert catalog.open_catalog(spark, path).chunks.count() == 0
    assert {r["id"] for r in last.chunks.collect()} == {"a", "b", "d"} and catalog.get_meta(last.meta, "window_version") == catalog.WINDOW_VERSION and catalog.get_meta(last.meta, "none", "x") == "x"
    for again in (catalog.index_run(old, new, windows("a", "b", "d"), force=True), catalog.index_run(old, new, windows("a", "b", "d"), version="2")):
        assert again.windows.where("vec is not null").count() == 0
    bare = catalog.Catalog(chunks(("a", "1", "x")).withColumn("vec", F.lit(None)), windows("a"), last.meta)
    assert {"vec", "vec_model"} <= set(catalog.migrated(bare).windows.columns) and "vec" not in catalog.migrated(bare).chunks.columns
    assert [r["value"] for r in catalog.set_meta(last.meta, window_version="7").collect()] == ["7"]


def test_search_modes_scopes_and_least_scores(spark):
    rows = [("c1", "one.md", "One", "Ann", "1990", "p1.jpeg", "-", "harbour towns of the north"), ("c2", "one.md", "One", "Ann", "1990", "p2.jpeg", "7", "harbour trade and grain"), ("c3", "two.md", "Two", "", "", "p3.jpeg", "", "winter roads and harbour"), ("c4", "two.md", "Two", "", "", "p4", "", "grain stores beyond")]
    chunks = spark.createDataFrame(rows, "id string, book_file string, book_title string, author string, year string, image string, page string, text string")
    windows = chunks.select(F.concat("id", F.lit("w")).alias("id"), F.col("id").alias("chunk_id"), "text").withColumn("vec", F.when(F.col("chunk_id") == "c4", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    asked = spark.createDataFrame([(1, "harbour grain"), (2, "xyzzy")], "query_id int, query string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    ix = index.build_index(chunks, "text")
    run = lambda **o: [(r["query_id"], r["id"], round(r["score"], 4)) for r in retrieval.search(ix, chunks, windows, asked, vectors, **o).orderBy("query_id", "rank").collect()]
    assert [x[1] for x in run(mode="dense", k=1)] == ["c4"] and run(mode="dense", min_score=2.0) == []
    lexical = run(mode="lexical", k=9)
    raw = {r["id"]: round(r["score"], 4) for r in retrieval.lexical(ix, asked).collect()}
    assert {x[1]: x[2] for x in lexical} == raw and lexical[0][1] == "c2"
    assert run(mode="hybrid", k=1)[0][:2] in ((1, "c2"), (1, "c4")) and all(x[2] < 0.1 for x in run(mode="hybrid", k=9))
    assert {x[1] for x in run(mode="hybrid", scope="two", k=9, per_book=1)} == {"c3", "c4"}  # one book lifts the cap
    assert len(run(mode="lexical", k=9, per_book=1)) == 2
    with pytest.raises(retrieval.ScopeMissError):
        run(scope="nobody")
    with pytest.raises(ValueError):
        run(mode="other")
    told_ = {r["id"]: r for r in retrieval.results(retrieval.search(ix, chunks, windows, asked, vectors, mode="lexical", k=9), chunks, asked, images="/in").collect()}
    assert told_["c2"]["page"] == "7" and told_["c1"]["page"] is None and told_["c4"]["image_path"] == "/in/p4.jpeg" and told_["c1"]["citation"] == "Ann, One (1990) · p1.jpeg"


def test_histories_and_tables_of_scores(spark):
    scores = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 1.0), ("n", "a", 0.25)], "model string, fixture string, score double")
    assert {r["model"]: (r["a"], r["b"], r["mean"]) for r in audit.score_table(scores).collect()} == {"m": (0.5, 1.0, 0.75), "n": (0.25, None, 0.25)}
    hits = spark.createDataFrame([(1, 1), (2, None)], "query_id int, first_rank int")
    row = audit.history_row(audit.recall_mrr(hits), spark.createDataFrame([("x.md",)] * 3, "book_file string"), "now", "hybrid", "e").first()
    assert (row["probes"], row["r1"], row["chunks"], row["books"], row["embed_model"], row["rerank_model"]) == (2, 0.5, 3, 1, "e", None)
    shots = spark.createDataFrame([("a", "PAGE", "body", "", 5), ("b", "COVER", "meta", "thin-text", 3), ("c", "PAGE", "body", "", 2)], "image string, type string, role string, reason string, chars long")
    assert [tuple(r) for r in audit.coverage_summary(shots).collect()] == [("emitted", 2, 7), ("thin-text", 1, 3)] and [r["image"] for r in audit.not_emitted(shots).collect()] == ["b"]
    listed = spark.createDataFrame([("x.md",), ("y.md",)], "book_file string")
    assert [r["book_file"] for r in audit.empty_books(listed, listed.where("book_file = 'x.md'")).collect()] == ["y.md"]


def test_small_texts(spark):
    one = lambda value: [r[0] for r in spark.createDataFrame([("A: b",), ('say "x"',), ("plain",), ("back\\slash #1",)], "x string").select(value).collect()]
    assert one(X.yaml_value(F.col("x"))) == ['"A: b"', '"say \\"x\\""', "plain", '"back\\\\slash #1"']
    assert one(X.is_echo(F.col("x"), ["say", "#1"])) == [False, True, False, True]
    got = spark.createDataFrame([("## IMG_4310.jpeg", 999.4), (" A b! ", 1234.0)], "x string, m double").select(X.heading_anchor(F.col("x")), X.distance(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("-img_4310jpeg", "999 m"), ("a-b", "1.2 km")]


def test_files(spark, tmp_path):
    (tmp_path / "book_1.md").write_text("---\ntitle: T\n---\n# T\n## a.jpeg\n### Page 3\ntext\n", encoding="utf-8")
    (tmp_path / "other.md").write_text("## b.jpeg\nno\n", encoding="utf-8")
    assert [(r["book_title"], r["image"], r["page"], r["text"]) for r in books.read_books(spark, str(tmp_path)).collect()] == [("T", "a.jpeg", "3", "text")]
    (tmp_path / "x.jpeg").write_bytes(b"abc")
    assert [tuple(r) for r in books.images(spark, str(tmp_path)).collect()] == [("x.jpeg", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    rows = spark.createDataFrame([("a", None), (None, "{broken")], "image string, _broken string")
    sound, broken = ingest.dead_letters(rows)
    assert [r["image"] for r in sound.collect()] == ["a"] and [r["_broken"] for r in broken.collect()] == ["{broken"]
