"""Which texts hold which of a set of passages, whole and to the character."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import tokens
from pagemill.session import ensure_checkpoint_dir

#: Characters of passages that one automaton holds, and that are sent to all tasks at a time.
MOST_CHARS = 16_000_000
#: Words of a key.
RUN = 5


def _runs(words: Column, k: int) -> Column:
    """Hashes of the runs of k words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


_automata: dict[int, object] = {}


def _automaton(sent):
    """The automaton of broadcast passages (no, passage), built once per worker process."""
    if sent.value[0] not in _automata:
        import ahocorasick

        _automata.clear()
        made = ahocorasick.Automaton()
        for no, passage in sent.value[1]:
            made.add_word(passage, no)
        made.make_automaton()
        _automata[sent.value[0]] = made
    return _automata[sent.value[0]]


def by_automaton(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, no) of `texts` (key, text) that hold passages (no, passage): an Aho-Corasick automaton of all of them reads each text once."""
    rows = [(r["no"], r["passage"]) for r in passages.select("no", "passage").collect()]
    sent = texts.sparkSession.sparkContext.broadcast((hash(tuple(rows)), rows))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(sent)
        for batch in incoming:
            found = [sorted({no for _, no in machine.iter(t)}) if t else [] for t in batch.column("text").to_pylist()]
            rows = pa.array([i for i, nos in enumerate(found) for _ in nos], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), pa.array([no for nos in found for no in nos], pa.int64())], ["key", "no"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(run, f"key {kind}, no long")


def by_keys(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, no) of `texts` (key, text) that hold passages (no, passage, inner, k) of three words and more, by an equi-join.

    A passage may begin and end inside a word, so its key is a run of its inner words, up to `RUN` of them, which a text that holds it has too.
    """
    held, found = texts.select("key", "text", tokens(F.col("text")).alias("w")), None
    for k in range(1, RUN + 1):
        part = passages.where(F.col("k") == k).select("no", "passage", F.get(_runs(F.col("inner"), k), F.lit(0)).alias("run"))
        met = held.select("key", "text", F.explode(F.array_distinct(_runs(F.col("w"), k))).alias("run")).join(part, "run")
        met = met.where(F.col("text").contains(F.col("passage"))).select("key", "no")
        found = met if found is None else found.unionByName(met)
    return found


def containment(texts: DataFrame, passages: DataFrame, key: str, name: str, most: int = MOST_CHARS) -> DataFrame:
    """(key, name): the rows of `texts` (key, text) that hold a passage of `passages` (name, passage) as it stands.

    Passages of up to `most` characters together are sent to all tasks as one automaton. Beyond that, those of three words and more are found by
    keys, and the short ones, of which there are as many as pairs of words at the most, by one automaton for each `most` characters. Empty and
    null passages are in no text.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    named = texts.select(F.col(key).alias("key"), "text")
    told = passages.select(F.col(name).alias("name"), "passage").where("passage <> ''")
    different = told.select("passage").distinct().select(F.monotonically_increasing_id().alias("no"), "passage").checkpoint()
    chars = F.coalesce(F.sum(F.length("passage")), F.lit(0))
    if different.agg(chars).first()[0] <= most:
        found = by_automaton(named, different)
    else:
        inner = F.slice(F.col("w"), 2, F.greatest(F.size("w") - 2, F.lit(0)))
        cut = different.withColumn("w", tokens(F.col("passage"))).withColumn("inner", inner).withColumn("k", F.least(F.size("inner"), F.lit(RUN)))
        found, short = by_keys(named, cut.where("k > 0")), cut.where("k = 0")
        parts = -(-short.agg(chars).first()[0] // most)
        for i in range(parts):
            found = found.unionByName(by_automaton(named, short.where(F.pmod(F.xxhash64("passage"), F.lit(parts)) == i)))
    out = found.join(different, "no").select("key", "passage").join(told, "passage").select("key", "name").distinct()
    return out.select(F.col("key").alias(key), F.col("name").alias(name))
