"""Incremental ingest is idempotent; closed sessions come out of the stream."""

import datetime as dt

from pagemill.streaming import attempts as A
from pagemill.streaming import ingest as S

UNIT = "book_file string, book_title string, author string, year string, image string, page string, text string"


def test_ingest_appends_what_is_new(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    row = lambda image, text: ("b.md", "T", "A", "1999", image, None, text)
    spark.createDataFrame([row("1.jpeg", "one"), row("2.jpeg", "two")], UNIT).coalesce(1).write.parquet(source)
    S.ingest(S.page_stream(spark, source, UNIT), target, checkpoint).awaitTermination()
    spark.createDataFrame([row("1.jpeg", "one"), row("2.jpeg", "two, mended"), row("3.jpeg", "three")], UNIT).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        S.ingest(S.page_stream(spark, source, UNIT), target, checkpoint).awaitTermination()
    chunks = spark.read.parquet(target)
    assert chunks.count() == 4
    assert {r["image"]: r["text"] for r in S.latest(chunks).collect()} == {"1.jpeg": "one", "2.jpeg": "two, mended", "3.jpeg": "three"}


def test_failing_rows_are_set_aside_and_tried_again(spark, tmp_path):
    results, failures, source, checkpoint = (str(tmp_path / n) for n in ("r", "f", "in", "cp"))
    schema = "id long, text string"

    def counted(row):
        if "bad" in row["text"]:
            raise ValueError(f"cannot read {row['id']}")
        return {"n": len(row["text"])}

    rows = spark.createDataFrame([(1, "one"), (2, "bad two"), (3, "three"), (3, "three")], schema)
    assert A.run_rows(rows, "id", counted, "n long", results, failures, "first") == (2, 1)
    assert A.run_rows(rows, "id", counted, "n long", results, failures, "second") == (0, 1)
    told = [(r["row"]["id"], r["attempt"], r["error"], r["at"]) for r in A.open_failures(spark, failures, rows.schema).orderBy("attempt").collect()]
    assert told == [(2, 1, "ValueError: cannot read 2", "first"), (2, 2, "ValueError: cannot read 2", "second")]
    assert A.run_rows(rows, "id", counted, "n long", results, failures, most=2) == (0, 0)
    # The same from a stream, whose failed rows come again from the failures alone.
    spark.createDataFrame([(4, "four"), (5, "bad five")], schema).coalesce(1).write.parquet(source)
    A.stream_rows(spark.readStream.schema(schema).parquet(source), "id", counted, "n long", results, failures, checkpoint).awaitTermination()
    assert A.retry(spark, rows.schema, "id", lambda row: {"n": 0}, "n long", results, failures) == (2, 0)
    assert {r["id"]: r["n"] for r in spark.read.parquet(results).collect()} == {1: 3, 2: 0, 3: 5, 4: 4, 5: 0}


def test_session_counts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(hours=5)), (1, t + dt.timedelta(hours=20)), (2, t + dt.timedelta(days=3))]
    spark.createDataFrame(rows, "user_id int, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id int, ts timestamp_ntz").parquet(str(tmp_path / "e"))
    query = S.session_counts(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["user_id"], r["n"]) for r in spark.table("closed").collect()) == [(1, 1), (1, 2)]
