"""Text expressions against plain Python, with the traps of the survey."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import fuzzy as Z
from pagemill.functions import text as X


def values(spark, column, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_strip_drops_all_white_space(spark):
    assert values(spark, X.strip, "\t a \n ", "", " x\x1c") == ["a", "", "x"]


@pytest.mark.parametrize("text", ["a\nb\n", "a\r\nb\x0bc\x85d", "", "\n", "a\n\nb", "x y\x1cz"])
def test_lines_are_those_of_python(spark, text):
    assert values(spark, X.lines, text) == [text.splitlines()]


def test_markdown_to_text(spark):
    assert values(spark, X.markdown_to_text, "# Head\n\n> *a* **b**\nc `d`\n\n\n- e\n", None) == ["Head\n\na b c d\n\ne\n", "\n"]


def test_quality_flags_repeats_and_vowelless_words(spark):
    prose = "one two three four five six seven eight nine ten"
    looped = "\n".join(["the same line again"] * 12)
    assert values(spark, X.text_quality, "ab cd", prose, "xxx zzz brr grr mmm", looped) == [1.0, 1.0, 0.0, round(1 / 12, 3)]
    assert values(spark, X.is_runaway, looped, prose, None) == [True, False, False]


def test_shot_types(spark):
    long = "word " * 200
    got = values(spark, X.shot_type, "ISBN 978-1-2", "A Title", "### Page 7\nshort", f"### Page 1\n{long}\n### Page 2\n{long}", long, f"### Page 1\n{long}\n### Page 2\nnothing", None)
    assert got == ["IMPRINT", "COVER", "PAGE", "SPREAD", "PAGE", "SPREAD", "COVER"]


def test_metadata(spark):
    text = "First published 1987 by\nSmall Press\nISBN: 978-0-14-044 913-6\nN305.80095 / 18"
    row = spark.createDataFrame([(text,)], "t string").select(X.isbn(F.col("t")), X.year(F.col("t")), X.publisher(F.col("t")), X.call_number(F.col("t")), X.metadata_block(F.col("t"), F.lit("T"))).first()
    assert row[0] == "978-0-14-044 913-6" and row[1] == "1987" and row[2] == "Small Press" and row[3] == "N305.80095/18"
    assert row[4].split("\n") == ["title: T", "publisher: Small Press", "year: 1987", "isbn: 978-0-14-044 913-6"]


def test_query_terms_are_ascii_and_keep_repeats(spark):
    assert values(spark, X.query_terms, "The cat, the CAT of Éire", "to be", None) == [["cat", "cat", "ire"], [], []]


def test_index_terms_fold_accents(spark):
    assert values(spark, X.index_terms, "Éire naïve don't snake_case Straße") == [["eire", "naive", "don", "t", "snake", "case", "straße"]]


def test_headers_and_page_numbers(spark):
    assert values(spark, X.running_header, "12\n\n# Page 3\n## The Sea\nbody", "") == ["The Sea", ""]
    assert values(spark, X.page_numbers, "### Page 3\n### Page 4", "x\n 17 \n18", "none") == [[3, 4], [17], []]


def test_citations(spark):
    row = spark.range(1).select(X.citation(F.lit("A. B"), F.lit("T"), F.lit("f.md"), F.lit("1999"), F.lit("I.jpeg"), F.lit("xiv")), X.citation(F.lit(""), F.lit(""), F.lit("f.md"), F.lit(""), F.lit("I.jpeg"), F.lit(None).cast("string")), X.embed_text(F.lit("T"), F.lit("A"), F.lit("3"), F.lit("x")), X.embed_text(F.lit(""), F.lit(""), F.lit(None).cast("string"), F.lit("x"))).first()
    assert list(row) == ["A. B, T (1999) · I.jpeg p.xiv", "f.md · I.jpeg", "A — T (p.3): x", "x"]


def test_slug_and_duration(spark):
    assert values(spark, X.slug, " Été: a  B_c! ", "!!!") == ["été-a-b-c", "book"]
    assert [r[0] for r in spark.createDataFrame([(1770.0,), (7500.0,)], "s double").select(X.duration(F.col("s"))).collect()] == ["30 min", "2 h 05 min"]


def test_similarity_is_the_matchers(spark):
    import difflib

    pairs = [("abcd" * 60, "bcda" * 61), ("", ""), ("kitten", "sitting"), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(Z.ratio("a", "b")).collect()]
    assert got == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert Z.titles_match("the long sea", "the long sea and its ports") and not Z.titles_match("ports", "passports of old") and not Z.titles_match("", "x")
