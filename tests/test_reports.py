"""Book files, index, report and logs of a small batch."""

import datetime as dt

from pyspark.sql import functions as F

from pagemill.operators import works
from pagemill.sources import books, reports
from tests.test_works import BODY, SHOT, T0, shot


def batch(spark):
    long = "Recovered prose of an imprint, which goes on. " + " ".join(f"word{i}" for i in range(80))
    rows = [shot("a", 1, kind="COVER", title="The Long: Sea", metadata="title: A\npublisher: P\n\ntitle: Other\nyear: 1"), shot("a", 2, long, kind="IMPRINT"), shot("a", 3, BODY), shot("a", 4, ""), shot("b", 11, f"Iron Roads\n{BODY}")]
    shots = spark.createDataFrame(rows, SHOT).withColumns({"capture_no": F.substring("image", 5, 3).cast("int"), "figures": F.array().cast("array<string>"), "page_numbers": F.array(F.lit(7)), "quality": F.lit(0.3), "seeds": F.when(F.col("work") == "a", F.array(F.lit("a"), F.lit("x"))).otherwise(F.array("work"))})
    titles = works.work_titles(shots)
    return shots, reports.numbered(works.work_records(shots, titles))


def test_book_files(spark, tmp_path):
    shots, records = batch(spark)
    got = {r["name"]: r["markdown"] for r in reports.book_texts(shots, records).collect()}
    first = got["book_01_the-long-sea"]
    assert first.startswith('---\ntitle: "The Long: Sea"\npublisher: P\nyear: 1\n---\n\n# The Long: Sea\n\n> _Assembled from 4 shots across multiple readings (seeds: a, x)._\n\n> _Other books visible in the cover/shelf photo:_\n\n```yaml\ntitle: Other\nyear: 1\n```\n\n## IMG_002.jpeg\n\n_(text recovered')
    assert first.endswith(f"## IMG_003.jpeg\n\n{BODY}\n") and "IMG_004" not in first and set(got) == {"book_01_the-long-sea", "book_02_iron-roads"}
    units = books.parse_books(spark.createDataFrame([("f.md", first)], "book_file string, raw string")).collect()
    assert {u["image"] for u in units} == {"IMG_002.jpeg", "IMG_003.jpeg"} and units[0]["book_title"] == "The Long: Sea"
    path = str(tmp_path / "out")
    reports.write_texts(spark.createDataFrame([("stale", "x")], "name string, markdown string"), path)
    reports.write_texts(reports.book_texts(shots, records), path)
    assert {r["name"] for r in spark.read.text(path).select("name").distinct().collect()} == set(got)


def test_index_and_report(spark):
    shots, records = batch(spark)
    lines = {r["image"]: r["line"] for r in reports.index_lines(shots, records).collect()}
    assert lines["IMG_002.jpeg"] == "| IMG_002.jpeg | IMPRINT | 1 |  | recovered |" and lines["IMG_004.jpeg"].endswith("| empty |") and lines["IMG_011.jpeg"] == "| IMG_011.jpeg | PAGE | 2 |  | ok |"
    sections = [r["markdown"] for r in reports.report_sections(shots, records, works.run_summary(shots)).orderBy("number").collect()]
    assert sections[0].startswith("## 1. [The Long: Sea](book_01_the-long-sea.md)\n\n_4 images · read 2024-05-05 09:00 · text yield p50 30_\n\n- **Title:** The Long: Sea\n- **Publisher:** P\n- **Year:** 1\n- **Captured:** 2024-05-01 09:01 → 09:04 (3 min, 4 shots)\n- **Cover/title shot(s):** IMG_001.jpeg, IMG_002.jpeg")
    assert "- [IMG_003.jpeg](book_01_the-long-sea.md#img_003jpeg) — p. 7 · low read quality (0.30)" in sections[0]


def test_logs(spark, tmp_path):
    shots, _ = batch(spark)
    path = str(tmp_path / "events")
    reports.append_lines(reports.events(shots.withColumn("elapsed_s", F.lit(1.234)), "now"), path)
    (tmp_path / "events" / "part-broken.txt").write_text("{broken\n", encoding="utf-8")
    rows = reports.read_log(spark, path, "image string, elapsed_s double, n_chars int, has_metadata boolean").collect()
    assert len(rows) == 5 and {r["image"]: (r["elapsed_s"], r["has_metadata"]) for r in rows}["IMG_001.jpeg"] == (1.23, True)
    history = spark.createDataFrame([("now", "hybrid", 0.5)], "at string, mode string, mrr double")
    for _ in range(2):
        reports.append_lines(history, str(tmp_path / "history"))
    assert reports.read_history(spark, str(tmp_path / "history")).count() == 2
    probes = spark.createDataFrame([("q", "one", None, None)], reports.PROBES)
    reports.append_lines(probes, str(tmp_path / "probes"))
    assert [tuple(r) for r in reports.read_probes(spark, str(tmp_path / "probes")).collect()] == [("q", "one", None, None)]


def test_the_cache_of_records_takes_the_last_read(spark):
    rows = [("a", "old", T0), ("b", "kept", T0), ("a", "new", T0 + dt.timedelta(hours=1)), ("a", "never", None)]
    table = spark.createDataFrame(rows, "image string, raw_md string, processed_at timestamp_ntz")
    got = reports.upserted_records(table.where("raw_md in ('old', 'kept')"), table.where("raw_md in ('new', 'never')"))
    assert {r["image"]: r["raw_md"] for r in got.collect()} == {"a": "new", "b": "kept"}
