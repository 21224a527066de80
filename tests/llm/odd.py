"""Documents that every operator must take: nulls, empty and very long texts, ties, repeats, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, kept int, print string, carried_0 string, row string, size string, label string, hits string, identity string"
LONG = " ".join(f"word{i % 977}" for i in range(20_000)) + "\n" + "x" * 30_000


def documents(spark):
    prose = "the cat and the dog went to the old harbour with a letter for the keeper of the light and they sat there until the rain had gone"
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, prose, "en", "b"), (None, None, None, None), (5, LONG, "en", "a"),
        (6, "Éire naïve ﬁ Ⅳ 漢字 \U0001f600\u0000 �", "fr", "b"), (7, " \t\n\r\x0b\x0c ", "fr", "b"), (-8, "one", "fr", None), (9, prose + " now", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "t", 1, "p", "c", "r", "s", "l", "h", "i") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
