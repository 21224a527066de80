"""Comparison of titles against all pairs, and what single shots say of their works."""

import difflib
import random
import re

from pyspark.sql import functions as F

from pagemill.functions import fuzzy, titles
from pagemill.operators import resolve


def made_titles(n, seed):
    rnd = random.Random(seed)
    words = ["harbour", "towns", "of", "old", "the", "long", "sea", "roads", "winter", "iron", "history", "trade", "letters"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7))) for _ in range(n // 2)]
    out = list(base)
    for t in base:
        letters = list(t)
        for _ in range(rnd.randint(1, 4)):
            letters[rnd.randrange(len(letters))] = rnd.choice("abcdeéß ")
        out.append("".join(letters))
    return [*out, "x" * 90, "x" * 88 + "yz", "", "a"]


def test_bounds_lose_no_pair_and_blocks_compare_all(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 30)
    left, right = sorted(set(made_titles(120, 1)) - {""}), sorted(set(made_titles(100, 2)) - {""})
    table = lambda ts: spark.createDataFrame([(t,) for t in ts], "title string")
    ratio = lambda least: lambda a, b: r if (r := difflib.SequenceMatcher(None, a, b).ratio()) >= least else 0.0
    for least in (0.6, 0.81, 0.85, 0.95):
        got = {(r["a"], r["b"]): r["score"] for r in fuzzy.title_pairs(table(left), table(right), least, ratio(least), None).collect()}
        assert got == {(a, b): ratio(least)(a, b) for a in left for b in right if ratio(least)(a, b)}
    held = {(r["a"], r["b"]) for r in fuzzy.title_pairs(table(left), table(right), fuzzy.TITLE_RATIO, fuzzy.titles_match).collect()}
    assert held == {(a, b) for a in left for b in right if fuzzy.titles_match(a, b)}


def test_titles_within_titles(spark):
    left, right = ["old sea", "sea", "the old sea roads", "old seas", "aaaaaa"], ["the old sea", "an old sea of old", "cold sea", "old sea", "x aaaaaa", "baaaaaa"]
    table = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id long, title string")
    words = {(left[r["a"]], right[r["b"]]) for r in fuzzy.word_pairs(table(left), table(right)).collect()}
    at_words = lambda a, b: len(a) >= 6 and f" {a} " in f" {b} "
    assert words == {(a, b) for a in left for b in right if at_words(a, b) or at_words(b, a)}
    texts = {(left[r["a"]], right[r["b"]]) for r in fuzzy.text_pairs(table(left), table(right), 6).collect()}
    assert texts == {(a, b) for a in left for b in right if a in b and len(a) >= 6 or b in a and len(b) >= 6}


def test_gram_index_asks_far_less_than_all_pairs(spark):
    rnd = random.Random(8)
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in "aeiou"]
    words = ["".join(rnd.choices(syllables, k=rnd.randint(2, 4))) for _ in range(3000)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(3, 7))) for _ in range(2000)]
    near = [t[:k] + "x" + t[k + 1 :] for t in base[:300] for k in [rnd.randrange(len(t))]]
    table = lambda ts: spark.createDataFrame([(t,) for t in ts], "title string")
    found, own, others = fuzzy.pair_candidates(table(base), table(base[1000:] + near), 0.85)
    n = found.count()
    met = found.join(own.withColumnRenamed("id", "a"), "a").join(others.select(F.col("id").alias("b"), F.col("title").alias("other")), "b").select("title", "other").collect()
    assert {(b, a) for b, a in zip(base[:300], near, strict=True)} | {(b, b) for b in base[1000:]} <= {tuple(r) for r in met}
    assert n < 0.01 * 2000 * 1300


def test_one_common_gram_or_title_makes_no_pairs(spark):
    # Every title has the same grams, and one entry stands in the table many times.
    rnd = random.Random(2)
    words = ["thand", "andth", "dthan", "hendt", "ntheh"]
    made = lambda n: [" ".join(rnd.choices(words, k=10)) for _ in range(n)]
    left, right = made(300), [*made(300), "the winter harbour of old iron roads and letters"]
    table = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id long, title string")
    right += [f"xx {t[:25]} yy" for t in left[:20]] + [t[3:40] for t in left[20:40]] + ["short one", "short o"]
    left += ["a winter harbour of old iron roads and letters", "short one"]
    texts = {(left[r["a"]], right[r["b"]]) for r in fuzzy.text_pairs(table(left), table(right), 20).collect()}
    assert texts == {(a, b) for a in left for b in right if a in b and len(a) >= 20 or b in a and len(b) >= 20} and texts
    parts = {(left[r["a"]], right[r["b"]]) for r in fuzzy.part_pairs(table(left), table(right), 6, 19, 0.7).collect()}
    assert parts == {("short one", "short one"), ("short one", "short o")}
    grams = lambda frame: frame._jdf.queryExecution().toString()
    found = fuzzy.block_pairs(table(left), table(right), 0.85)
    # Counts of grams stay in tasks: no plan explodes them.
    assert "Generate posexplode" not in grams(found) and "posexplode" not in grams(fuzzy.pair_candidates(table(left), table(right), 0.85)[0])
    want = {(a, b) for a, s in enumerate(left) for b, t in enumerate(right) if difflib.SequenceMatcher(None, s, t).ratio() >= 0.85}
    assert want <= {(r["a"], r["b"]) for r in found.collect()}


def test_bibliography_ties_over_equal_titles_and_forms(spark):
    works = spark.createDataFrame([(f"w{i}", "", t) for i, t in enumerate([["The Long Sea: Trade"], ["The Long Sea: Trade"], ["The Iron Roads", "The Long Sea"], ["Alone In Winter"], ["Preface"]])], "work string, isbn string, titles array<string>")
    entries = [*["The Long Sea: Trade"] * 3, "The Iron Roads", "The Iron Road", "Alone In Winter: Two"]
    listed = spark.createDataFrame([(i, "BOOK", t, "", "") for i, t in enumerate(entries)], "position int, type string, title string, container string, isbn string")
    got = {r["work"]: (r["position"], r["tie"], r["score"]) for r in resolve.match_bibliography(works, listed).collect()}
    assert got == {"w0": (0, True, 0.99), "w1": (0, True, 0.99), "w2": (0, True, 0.99), "w3": (5, False, 0.99)}


def _plain(title):
    return " ".join(title.lower().split())


def test_title_candidates_against_all_pairs(spark):
    rnd = random.Random(4)
    named = [t.strip().title() for t in made_titles(70, 3) if t.strip()]
    named += rnd.choices(named, k=30)
    rows = [(f"w{i:03d}", i, t, rnd.choice(["", "", "12", "34"]), rnd.choice(["", "", "N1/2"]), i % 11 != 0) for i, t in enumerate(named)]
    works = spark.createDataFrame(rows, "work string, position int, title string, isbn string, call string, has_body boolean")
    sure = {r["work"] for r in works.where(titles.confident(F.col("title"))).collect()}
    rows = [r for r in rows if r[5] and r[0] in sure]
    key = {r[0]: r[3] or r[4] for r in rows}

    def score(a, b):
        if key[a[0]] and key[b[0]] and key[a[0]] != key[b[0]]:
            return 0
        same = _plain(a[2]) == _plain(b[2])
        generic = any(re.match(resolve.GENERIC_START, t[2]) for t in (a, b))
        return 3 * same + 2 * (same and bool(key[a[0]] or key[b[0]])) + (len(_plain(a[2])) >= 20) - 3 * generic

    every = {(a[0], b[0]): s for i, a in enumerate(rows) for b in rows[i + 1 :] if fuzzy.titles_match(_plain(a[2]), _plain(b[2])) and (s := score(a, b)) > 0}
    told = resolve.title_candidates(works).collect()
    got = {(r["a"], r["b"]): r["score"] for r in told}
    assert len(got) == len(told) and got.items() <= every.items()
    # Every pair is there, or one between the first works of the same titles and keys.
    first = {}
    for r in rows:
        first.setdefault((_plain(r[2]), key[r[0]]), r[0])
    stands = {r[0]: first[_plain(r[2]), key[r[0]]] for r in rows}
    lost = [(a, b) for a, b in every if tuple(sorted((stands[a], stands[b]))) not in every or stands[a] != stands[b] and tuple(sorted((stands[a], stands[b]))) not in got]
    assert every and not [p for p in lost if stands[p[0]] != stands[p[1]] and tuple(sorted((stands[p[0]], stands[p[1]]))) in every]
    assert all((stands[a], a) in got for a in key if stands[a] != a and (stands[a], a) in every)
    assert [r["score"] for r in told] == sorted((r["score"] for r in told), reverse=True)


def test_a_title_meets_others_through_every_key(spark):
    long = "The Harbour Towns Of The Old Winter Roads"
    rows = [("w1", 1, long, "111", ""), ("w2", 2, long, "", ""), ("w3", 3, long + "s", "222", "")]
    works = spark.createDataFrame(rows, "work string, position int, title string, isbn string, call string")
    assert [tuple(r) for r in resolve.title_candidates(works).collect()] == [("w1", "w2", 6), ("w2", "w3", 1)]


def test_bibliography_match_against_all_pairs(spark):
    asked, listed = made_titles(60, 4), made_titles(60, 5) + made_titles(30, 4)
    works = spark.createDataFrame([(i, "", [t]) for i, t in enumerate(asked)], "work int, isbn string, titles array<string>")
    entries = spark.createDataFrame([(i, "BOOK", t, "", "") for i, t in enumerate(listed)], "position int, type string, title string, container string, isbn string")
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for i, t in enumerate(asked):
        scored = [(resolve._alike(fold(t), fold(e)), -j) for j, e in enumerate(listed)] if len(fold(t)) >= 6 else []
        if scored and max(scored)[0] >= 0.85:
            want[i] = -max(scored)[1]
    assert {r["work"]: r["position"] for r in resolve.match_bibliography(works, entries).collect()} == want


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def test_title_like_lines(spark):
    told = {"The Long Sea": True, "1997": False, "ISBN 12": False, "x" * 50: False, "Plate IV": False, "Photo Album": True, "page 12": False, "hello there my": True, "a b c d e f g h": False, "THE LONG": True, "Fig. 2 A map": False, "Chart 3": False, None: None}
    assert [r[0] for r in values(spark, list(told), titles.title_like(F.col("x")))] == list(told.values())
    assert [r[0] for r in values(spark, ["Roads", "roads", "", None], titles.confident(F.col("x")))] == [True, False, False, False]
    assert [r[0] for r in values(spark, ["Denis Wood", "The Wood", "D. Wood & Ann Lee", "Roads of Iron", "", "A B C D E F G"], titles.looks_like_names(F.col("x")))] == [True, False, True, False, False, False]


def test_titles_of_shots(spark):
    rows = [
        ("meta", "COVER", None, None, "### Page 1\nN305.80095/18\nTHE LONG\nSEA\n\nA. Writer"), ("meta", "IMPRINT", None, 'title: "Roads"', ""), ("meta", "IMPRINT", None, "title: page 3", "Cataloguing-in-Publication data\n\niron roads / A. Writer"),
        ("meta", "COVER", " Big ", "title: Small", ""), ("body", "PAGE", None, None, "12\n# Alpha Harbour\ntext"), ("body", "PAGE", None, None, "A sentence that goes on for longer than a title may be, by far.\nAlpha"), (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "role string, kind string, cover string, metadata string, text string")
    got = frame.select(titles.shot_title(*[F.col(c) for c in ("role", "kind", "cover", "metadata", "text", "text")]).alias("t")).collect()
    assert [r[0] for r in got] == ["THE LONG SEA", "Roads", "Iron roads", "Big", "Alpha Harbour", "", ""]


BOXES = """```json
[{"category":"Title","bbox":[100,100,500,200],"text":"The Long"},{"category":"Title","bbox":[100,210,500,300],"text":"Sea"},{"category":"Text","bbox":[120,310,480,340],"text":"A story of the coast"},
 {"category":"Text","bbox":[120,345,480,370],"text":"Denis Wood"},{"category":"Picture","bbox":[0,0,1,1]},{"category":"Title","bbox":[900,100,950,200],"text":"THE LONG"},{"category":"List-item","bbox":[600,310,900,330],"text":"Other page"}]
```"""


def test_layouts(spark):
    boxes = titles.layout_boxes(F.col("x"))
    got = values(spark, [BOXES, "none", "[]", "[1,2", None, '[{"category":"Title","text":"12"}]'], F.size(boxes), titles.figure_regions(boxes), titles.cover_title_of(boxes))
    assert got == [(7, 1, "The Long Sea A story of the coast"), (None, 0, ""), (0, 0, ""), (None, 0, ""), (None, 0, ""), (1, 0, "")]


def test_metadata_of_several_works(spark):
    text = "```yaml\ntitle: A\npublisher: P\nyear:\n```\n\n\n\n```yaml\ntitle: B\nyear: 1990\npublisher: Q\n```"
    docs = titles.metadata_docs(titles.clean_metadata(F.col("x")))
    assert values(spark, [text, None], docs, titles.bibliographic_fields(docs, F.lit("N1"))) == [(["title: A\npublisher: P\nyear:", "title: B\nyear: 1990\npublisher: Q"], {"publisher": "P", "year": "1990", "call_number": "N1"}), ([], {"call_number": "N1"})]


def test_figures(spark):
    text = "Intro\n# Map 3 The coast\ntext\n> Map 3 The coast\nFigure IX x"
    captions = titles.figure_captions(F.col("x"))
    assert values(spark, [text, "", None], captions, titles.with_figure_marks(F.col("x"), captions)) == [
        (["Map 3 The coast", "Map 3 The coast", "Figure IX x"], "Intro\n> **[Figure — Map 3 The coast]**\ntext\n> Map 3 The coast\n> **[Figure — Figure IX x]**"), ([], ""), ([], "")]


def test_spines(spark):
    text = "Wag 12\nUser Group: staff\nThe Long Sea\nWRITER\nOxford Press\nWag 13\nGENERAL REF\nWag 14\nuser group\nRoads of Iron (1)\nIron Roads"
    assert values(spark, [text, None], titles.spine_titles(F.col("x"))) == [([["staff", "The Long Sea"], ["Iron Roads"]],), ([],)]
