"""Targets against plain repeated sharing; taken words against targets; the odd cases."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pagemill.llm import source_mix

SCHEMA = "doc_id long, text string, source string, size string, target int"


def shared(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Share by weight, stop at three times the size, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_mix.mix(docs, F.col("doc_id"), F.col("source")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = shared(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for doc_id, source, size, source_size, target, copies, words in got:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= copies <= 3 and words == copies * size
        taken[source] += words
        largest[source] = max(largest[source], size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(3 * largest[source], 0.05 * want[source])
    assert len(got) == len(rows)
    return got


def test_targets_and_taken_words(spark):
    rows = []
    for i in range(900):
        source = f"s{i % 2}" if i % 3 else f"t{i % 7}"
        rows.append((i, " ".join(["w"] * (1 + i * 7919 % 90)), source, "x", 1))
    first = check(spark, rows)
    assert sorted(first) == sorted(check(spark, rows))


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(0, "a b", "a", "x", 1), (1, "c", "b", "x", 1)] + [(i, "w w w w", "c", "x", 1) for i in range(2, 300)]
    got = {s: t for _, s, _, _, t, _, _ in check(spark, rows)}
    assert got["a"] == 6 and got["b"] == 3


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "a", "x", 1), (1, "b b", "a", "x", 1), (1, "b b", "a", "x", 1), (2, " \t\n", None, "x", 1), (-5, "x y z", None, "x", 1)]
    check(spark, rows)
    assert source_mix.mix(spark.createDataFrame([], SCHEMA), F.col("doc_id")).collect() == []
    assert check(spark, [(7, None, "a", "x", 1)])[0][4] == 0


def test_documents_come_out_as_often_as_they_are_taken(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 4}", "kept", 3) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {r[0]: r["copies"] for r in source_mix.mix(docs, F.col("doc_id")).collect()}
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
