import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import phrase_graph
from tests.llm import odd

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def pieces_of(text):
    return [[w for w in re.split(r"[\x20\x09]+", piece) if w] for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def counted(rows, longest):
    """Counter of (lang, words) for all runs of up to `longest` words."""
    found = Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            for k in range(1, longest + 1):
                found.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return found


def by_hand(rows, longest=3, least=10, top=2000):
    counts = counted(rows, longest)
    totals = Counter()
    for (lang, w), n in counts.items():
        if len(w) == 1:
            totals[lang] += n
    frequent = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    held = set()
    for (lang, w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 50 * frequent[lang, w[i : i + k]]:
                    held.add((lang, w[i : i + k]))
    told = {}
    for (lang, w), a in frequent.items():
        if (lang, w) not in held:
            cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            told.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, found in told.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def mined(docs, longest=3, **options):
    return sorted(tuple(r) for r in phrase_graph.collocations(phrase_graph.graph(docs, longest=longest), **options).collect())


def texts(seed, n=400):
    """Texts of a small vocabulary with phrases, copied passages, repeats and cycles."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    words = [*"abcdefgh", "Éa", "é", "New", "york", "city"]
    rows = []
    for i in range(n):
        body = [rng.choice([*words, "new york city", "of the", "x y x y x", "q q q q"]) for _ in range(rng.randint(0, 25))]
        body.insert(rng.randint(0, len(body)), passage if i % 5 == 0 else ", ")
        rows.append((rng.choice(["en", "fr", None]), rng.choice([" ", "  ", "\t"]).join(body) + rng.choice([".", "!\n", "", ";;"])))
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_equal_counting_by_hand(spark, longest):
    rows = texts(longest)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(docs, longest) == by_hand(rows, longest)


def test_flow_and_ends_give_all_shorter_counts(spark):
    rows = texts(9, 120)
    found = phrase_graph.graph(spark.createDataFrame(rows, "lang string, text string"))
    told = {(r["lang"], tuple(r["run"].split(" "))): r["n"] for level in found.levels.values() for r in level.collect()}
    every = counted(rows, 3)
    assert all(n <= every[key] for key, n in told.items())
    assert {k: n for k, n in told.items() if n >= 10 or len(k[1]) == 1} == {k: n for k, n in every.items() if n >= 10 or len(k[1]) == 1}
    assert {r["lang"]: r["n"] for r in found.totals.collect()} == {x: sum(n for (lang, w), n in every.items() if lang == x and len(w) == 1) for x in ("en", "fr", "und")}


def test_words_of_odd_batches():
    texts = pa.array(["a.b c", None, "", "  É\u00a0x\tY ;; z", "end", "go on\x00on", ".", "q" * 9], pa.string())
    found = phrase_graph.Words(texts.slice(1))
    words = [found.names[c].as_py().decode() for c in found.codes.tolist()]
    assert words == ["É\u00a0x", "y", "z", "end", "go", "on\x00on", "q" * 9] and found.text.tolist() == [2, 2, 2, 3, 4, 4, 6]
    assert found.goes_on.tolist() == [True, False, False, False, True, False, False]
    assert len(phrase_graph.Words(pa.array([None, "", " . "], pa.string())).codes) == 0
    assert len(phrase_graph.Words(pa.array([], pa.string())).codes) == 0


def test_paths_hold_every_frequent_edge_once(spark):
    rows = texts(3, 300)
    paths = phrase_graph.compacted(phrase_graph.graph(spark.createDataFrame(rows, "lang string, text string"))).collect()
    edges = [((r["lang"], tuple(r["words"][i : i + 3])), r["n"]) for r in paths for i in range(len(r["words"]) - 2)]
    assert sorted(edges) == sorted((k, n) for k, n in counted(rows, 3).items() if len(k[1]) == 3 and n >= 10)
    lengths = sorted(len(r["words"]) for r in paths)
    assert lengths[-1] == 60 and [r["words"] for r in paths if len(r["words"]) == 60][0] == [f"p{i}" for i in range(60)]


def test_top_and_ties(spark):
    rows = [("en", f"tie{i} ends{i}") for i in range(30) for _ in range(10)]
    found = mined(spark.createDataFrame(rows, "lang string, text string"), top=7)
    assert found == by_hand(rows, top=7) and [r[2] for r in found] == sorted(f"tie{i} ends{i}" for i in range(30))[:7]


def test_scores_past_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 5 * 10**13 + 1, 10**13 + 3
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrase_graph.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (left * right)
    exact = spark.createDataFrame([(10**15 - 1, 10**15 - 1, 10**15)], "a long, l long, r long").select(phrase_graph.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert exact["s"] == 10**6 * (10**15 - 1) ** 2 // ((10**15 - 1) * 10**15)


def test_odd_documents_and_empty_tables(spark):
    docs = odd.documents(spark)
    many = docs
    for _ in range(4):
        many = many.unionByName(many)
    rows = [(r["lang"], r["text"]) for r in many.select("lang", "text").collect()]
    assert mined(many) == by_hand(rows)
    assert mined(odd.empty(spark)) == []


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_runs_travel_in_less_than_half_of_their_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(3000)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [("en", " ".join(rng.choices(words, weights, k=400))) for _ in range(2500)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2).cache()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    found = {tuple(r["run"].split(" ")): r["n"] for r in phrase_graph.runs(docs).where("size = 3").collect()}
    assert 0 < shuffled(spark) - before < size / 2
    every = counted(rows, 3)
    assert {w for (_, w), n in every.items() if len(w) == 3 and n >= 10} <= found.keys() and all(n == every["en", w] for w, n in found.items())
    docs.unpersist()


@pytest.mark.parametrize("least", [1, 10, 300])
def test_packed_counts_find_the_frequent_buckets(least):
    rng = np.random.default_rng(least)
    edges = [0, phrase_graph.RANGE - 1, phrase_graph.RANGE, phrase_graph.BUCKETS - 1]
    batches = [np.concatenate((rng.integers(0, 2000, 30 * least), rng.integers(0, phrase_graph.BUCKETS, 500), edges * (2 * least), [7] * 70_000)).astype(np.int32) for _ in range(3)]
    (told,) = phrase_graph._frequent_buckets(iter([phrase_graph._packed_counts(b, least) for b in batches]), least)
    bits = np.zeros(phrase_graph.BUCKETS, bool)
    for number, held in zip(*(c.to_pylist() for c in told.columns), strict=True):
        bits[number * phrase_graph.RANGE :][: phrase_graph.RANGE] = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")
    assert np.flatnonzero(bits).tolist() == np.flatnonzero(np.bincount(np.concatenate(batches)) >= least).tolist()
    assert all(bits[e] for e in edges)


def test_tasks_that_send_many_times_count_the_same(spark, monkeypatch):
    rows = texts(11, 200)
    monkeypatch.setattr(phrase_graph, "SLICE", 700)
    monkeypatch.setattr(phrase_graph, "GATHERED", 3000)
    assert mined(spark.createDataFrame(rows, "lang string, text string").repartition(3)) == by_hand(rows)
