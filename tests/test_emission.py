"""Outputs after several batches equal those of one, and untouched books are left alone."""

import datetime as dt
import os

from pagemill.streaming import emission as E

SCHEMA = (
    "roll int, image string, type string, role string, time timestamp_ntz, lat double, lon double, cover_title string, metadata string, ocr_text string, raw_md string, page_numbers array<int>, "
    "figures array<string>, quality double, text_score int, processed_at timestamp_ntz"
)
BODY = "long body text that is no title because it runs on and on past the length that a title may have"
T0 = dt.datetime(2024, 5, 1, 9)


def shot(roll, n, title=None, text=BODY, day=0):
    cover = title is not None
    image, time = f"IMG_{roll}{n:03d}.jpeg", T0 + dt.timedelta(days=roll, minutes=n)
    return (roll, image, "COVER" if cover else "PAGE", "meta" if cover else "body", time, None, None, title, "", title or text, "" if cover else text, [n], [], 0.9, 5, T0 + dt.timedelta(days=100 + day))


def rolls():
    out = []
    for roll in range(6):
        for work, title in enumerate(("The Harbour Towns", "Iron Roads North", "Winter Letters")[: 1 + roll % 3]):
            out += [shot(roll, 20 * work, f"{title} {roll}".title())] + [shot(roll, 20 * work + k, text=f"{BODY} {roll} {work} {k}") for k in range(1, 4)]
    return out


def held(spark, target):
    books = {r["name"]: r["value"] for r in spark.read.option("wholetext", True).text(f"{target}/books").collect()}
    return books, sorted(tuple(r) for r in spark.read.parquet(f"{target}/lines").select("roll", "image", "line").collect())


def written(target):
    return {d: max(os.path.getmtime(os.path.join(target, "books", d, f)) for f in os.listdir(os.path.join(target, "books", d)) if f.endswith(".txt")) for d in os.listdir(os.path.join(target, "books")) if d.startswith("name=")}


def test_batches_rewrite_touched_works_alone_and_equal_a_full_run(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows, target, whole = rolls(), str(tmp_path / "out"), str(tmp_path / "whole")
    late = [r for r in rows if r[0] == 2][5:] + [r for r in rows if r[0] == 5]
    early = [r for r in rows if r not in late]
    first = {r["name"]: r["change"] for r in E.emit(table(early), f"file:{target}").collect()}
    assert set(first.values()) == {"NEW"}
    before = written(target)
    # The rest of roll 2, the whole of roll 5, and a page of roll 0 read anew.
    again = [shot(0, 2, text=f"{BODY} read once more", day=1)]
    feed = {r["name"]: r["change"] for r in E.emit(table(late + again), f"file:{target}").collect()}
    after = written(target)
    changed = {n for n, c in feed.items() if c in ("NEW", "CHANGED")}
    assert {d[5:] for d, t in after.items() if before.get(d) != t} == changed
    assert all(after[d] == t for d, t in before.items() if d[5:] not in changed and d in after) and {n[:6] for n, c in feed.items() if c == "CHANGED"} == {"book_i"}
    E.emit(table([r for r in rows if r[:2] != again[0][:2]] + again), f"file:{whole}")
    assert held(spark, f"file:{target}") == held(spark, f"file:{whole}")
    # The same batch once more finds everything as it is.
    assert {r["change"] for r in E.emit(table(late + again), f"file:{target}").collect()} == {"KEPT"} and written(target) == after


def test_books_that_are_no_more_go(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    target = str(tmp_path / "out")
    E.emit(table([shot(1, 1, "Iron Roads"), shot(1, 2)]), f"file:{target}")
    feed = {r["change"] for r in E.emit(table([shot(1, 1, "Winter Letters", day=1)]), f"file:{target}").collect()}
    assert feed == {"NEW", "GONE"} and len(written(target)) == 1
    assert E.emit(table([]), f"file:{target}").collect() == []


def test_emission_from_a_stream(spark, tmp_path):
    source, target, whole = (f"file:{tmp_path}/{n}" for n in ("in", "out", "whole"))
    rows = rolls()
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        E.emit_stream(stream, target, f"{tmp_path}/cp").awaitTermination()
    E.emit(spark.createDataFrame(rows, SCHEMA), whole)
    assert held(spark, target) == held(spark, whole)
