"""Phrases that belong together, from a weighted de Bruijn graph of words.

A node is a run of LONGEST - 1 words, an edge one of LONGEST words that leads from the run without its last word to the run without
its first. Only edges are counted over the corpus: every place of a piece gives the run of up to LONGEST words that begins there, and runs cut short by
the end of their piece are kept beside the edges as corrections. Counts of shorter runs are the flow that leaves them, plus
the corrections: f(x) is the sum of f(x y) over all words y, plus the pieces that end in x. Most runs are met once or twice: earlier passes add up runs in
hashed buckets, and runs also end where their bucket is too rare for any candidate, so such runs are not counted.

Paths without branches are then compacted: where an edge weighs as much as both of its nodes, nothing else enters or leaves
between them and no piece begins or ends there, so all edges of such a path have one weight. Paths are found by
pointer doubling over the edges that are frequent enough to be candidates, and candidates are read from them. A node on the inside of a path
is held by an edge of its own weight, so it is no phrase of its own.

Defined results: a null text counts as empty; a null language is `und`; pieces without words give nothing; texts are whole rows, repeated rows
count each time; an empty table gives an empty one. Equal scores go to the larger count, then to the phrase that comes first by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.piece_bpe import slices

LONGEST = 3
LEAST = 10
TOP = 2000
HELD_PERCENT = 50
SCALE = 1_000_000
UNKNOWN = "und"
#: Bytes of text that are counted together before anything is shuffled; buckets of runs.
SLICE = 1_500_000
BUCKETS = 2**26
#: Buckets whose counts travel in one row; parts that the runs of a language are dealt to; bytes that a task gathers before it packs them.
RANGE = 2**16
PARTS = 1024
GATHERED = 2**25


@dataclass
class PhraseGraph:
    """levels[k] (lang, run, n) counts the runs of k words, totals (lang, n) all words. Counts of `least` and more and those of single words are
    whole; those of rarer runs are left out or short."""

    levels: dict[int, DataFrame]
    totals: DataFrame
    longest: int


def _first(run: Column, k: int) -> Column:
    return F.substring_index(run, " ", k)


def _rest(run: Column, size: int, k: int) -> Column:
    """A run of `size` words without its first k."""
    return F.substring_index(run, " ", k - size)


class Words:
    """The words of a batch of texts as numbers: `codes` into the array `names`, the text of each, and whether the next one follows in the same piece.

    All marks are single bytes of UTF-8, so whole batches are cut as arrays of bytes.
    """

    def __init__(self, texts: pa.Array):
        told = pc.ascii_lower(pc.fill_null(texts, ""))
        offsets = np.frombuffer(told.buffers()[1], np.int32)[told.offset : told.offset + len(told) + 1]
        raw = np.frombuffer(told.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = KINDS[raw]
        inside = kind == 0
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        heads = offsets[:-1][np.diff(offsets) > 0]
        before[heads] = False  # a text's first byte goes on from no other
        starts = np.flatnonzero(inside & ~before)
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        # Words of one piece have as many piece ends before them.
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else starts
        self.goes_on = np.zeros(len(starts), bool)
        self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        stretch = np.concatenate((np.cumsum(inside, dtype=np.int32)[starts] - 1, [np.count_nonzero(inside)])) if len(starts) else np.zeros(1, np.int64)
        told = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(stretch.astype(np.int64)), pa.py_buffer(raw[inside])])
        coded = told.dictionary_encode()
        self.codes, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.hashes = _hashes(self.names)


#: What a byte is: 1 a blank between words, 2 the end of a piece, 0 part of a word.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b"\x20\x09")] = 1
KINDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


def _hashes(values: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(x) for x in values.to_pylist()], np.uint64)


def _buckets(found: Words, langs: np.ndarray, bits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of two words, three and so on, up to one more than `bits` has filters for: the bucket of the run that begins at each word, and
    whether it may be frequent, as it lies within its piece and all shorter runs in it are."""
    hashes = found.hashes[found.codes]
    size = len(hashes)
    alive, before = np.ones(size, bool), np.ones(size, bool)
    with np.errstate(over="ignore"):
        mixed = (hashes + langs[found.text]) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, len(bits) + 2):
            alive[: size - k] &= found.goes_on[k - 1 : size - 1]
            # The run without its last word may be frequent (it is alive), and so may the one without its first.
            alive[: size - k] &= before[1 : size - k + 1]
            alive[size - k :] = False
            mixed[: size - k] = (mixed[: size - k] ^ (mixed[: size - k] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k:] * np.uint64(0x94D049BB133111EB)
            bucket = ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)
            if k <= len(bits):
                alive &= (bits[k - 1][bucket >> 3] >> (bucket & 7)) & 1 > 0
            yield bucket, alive
            before = alive.copy()


def _named(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))


def _packed_counts(buckets: np.ndarray, least: int) -> pa.RecordBatch:
    """(number, places, counts): how often each bucket is met, up to `least`; a row holds all of one range that are met, two bytes a place and mostly one a count."""
    told, counts = np.unique(buckets, return_counts=True)
    number, start = np.unique(told // RANGE, return_index=True)
    columns = [pa.array(number.astype(np.int32))]
    for values in ((told % RANGE).astype(np.uint16), np.minimum(counts, least).astype(np.min_scalar_type(2 * least))):
        offsets = (np.append(start, len(told)) * values.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(columns, ["number", "places", "counts"])


def _frequent_buckets(incoming: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(number, bits): of packed counts, one bit a bucket of each range: whether it is met `least` times in all. A range takes `RANGE` short sums at any size of the corpus."""
    kind = np.min_scalar_type(2 * least)
    sums: dict[int, np.ndarray] = {}
    for batch in incoming:
        for number, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held, at = sums.setdefault(number, np.zeros(RANGE, kind)), np.frombuffer(places, np.uint16)
            # A sum that has reached `least` needs no more.
            held[at] = np.minimum(held[at] + np.frombuffer(counts, kind), least)
    bits = [np.packbits(held >= least, bitorder="little").tobytes() for held in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["number", "bits"])


def frequent_runs(docs: DataFrame, longest: int, least: int, text: str = "text", lang: str = "lang") -> list[Broadcast]:
    """For runs of two words, three and so on up to `longest`, one bit a bucket of runs: whether all runs of the bucket together are met `least` times. A run in
    another bucket is no candidate, and in none.

    Counts are added up per bucket, by ranges of them; what reaches the driver, and every task from there, are bitmaps of `BUCKETS` bits, 8 MB each at any size of the corpus.
    """
    found: list[Broadcast] = []
    for _ in range(2, longest + 1):
        known = tuple(found)

        def count(incoming: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in incoming:
                for at, n in slices(batch.column("text"), SLICE):
                    part = batch.slice(at, n)
                    *_, (bucket, alive) = _buckets(Words(part.column("text")), _hashes(part.column("lang")), [b.value for b in known])
                    held.append(bucket[alive].astype(np.int32))
                    if sum(x.nbytes for x in held) >= GATHERED:
                        yield _packed_counts(np.concatenate(held), least)
                        held = []
                pa.default_memory_pool().release_unused()
            if held:
                yield _packed_counts(np.concatenate(held), least)

        met = _named(docs, text, lang).mapInArrow(count, "number int, places binary, counts binary").repartition("number")
        bits = np.zeros(BUCKETS // 8, np.uint8)
        for row in met.mapInArrow(lambda incoming: _frequent_buckets(incoming, least), "number int, bits binary").collect():
            bits[row["number"] * RANGE // 8 :][: RANGE // 8] = np.frombuffer(row["bits"], np.uint8)
        found.append(docs.sparkSession.sparkContext.broadcast(bits))
    return found


def _numbered(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


def _summed(held: list[pa.Table]) -> pa.Table:
    """Counted runs of several slices, equal ones added up."""
    return pa.concat_tables(held).group_by(["part", "lang", "run"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["part", "lang", "run", "n"])


def _packed_runs(told: pa.Table) -> pa.RecordBatch:
    """(lang, part, runs, counts): a row holds all runs of a part of a language, as lines, and their counts. Equal counts stand together, so they take next to nothing once compressed."""
    told = told.combine_chunks()
    part, n = told["part"].to_numpy(), told["n"].to_numpy()
    langs = told["lang"].combine_chunks().dictionary_encode()
    key = langs.indices.to_numpy().astype(np.int64) * PARTS + part
    order = np.lexsort((n, key))
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    offsets, first = pa.array(np.append(start, len(key)), pa.int32()), order[start]
    # No word holds the end of a line.
    lines = pc.binary_join(pa.ListArray.from_arrays(offsets, told["run"].combine_chunks().take(pa.array(order))), "\n")
    counts = pa.ListArray.from_arrays(offsets, pa.array(n[order]))
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(langs.indices.to_numpy()[first])), pa.array(part[first]), lines, counts], ["lang", "part", "runs", "counts"])


def runs(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, run, size, n): how often each run of up to `longest` words begins at a place; shorter ones where their piece ends.

    Runs also end before a word with which they are too rare for any candidate (`frequent_runs`): every word still begins one run, and every frequent
    run is counted whole, or as the beginning of a longer one. A task adds up its own runs and sends those of a part as one row.
    """
    filters = frequent_runs(docs, longest, least, text, lang)

    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in incoming:
            for at, n in slices(batch.column("text"), SLICE):
                part = batch.slice(at, n)
                found = Words(part.column("text"))
                if not len(found.codes):
                    continue
                langs = part.column("lang").dictionary_encode()
                # Runs grow word by word, and equal ones get one number.
                size, names = len(found.codes), len(found.names) + 1
                number = _numbered(langs.indices.to_numpy()[found.text] * names + found.codes)
                length = np.ones(size, np.int64)
                steps = _buckets(found, _hashes(part.column("lang")), [b.value for b in filters])
                for k, (_, alive) in zip(range(1, longest), steps, strict=False):
                    length += alive
                    number = _numbered(number * names + np.where(alive, np.roll(found.codes, -k), names - 1))
                counts, first = np.bincount(number), np.zeros(number.max() + 1, np.int64)
                first[number[::-1]] = np.arange(size)[::-1]
                words, mixed = [], np.zeros(len(first), np.uint64)
                for k in range(longest):
                    at = np.where(length[first] > k, found.codes[np.minimum(first + k, size - 1)], 0)
                    with np.errstate(over="ignore"):
                        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.where(length[first] > k, found.hashes[at], np.uint64(0))
                    words.append(found.names.take(pa.array(at, mask=length[first] <= k)))
                run = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()), null_handling="skip").cast(pa.large_string())
                told = langs.dictionary.take(pa.array(langs.indices.to_numpy()[found.text[first]]))
                part = ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(PARTS - 1)).astype(np.int32)
                held.append(pa.table([pa.array(part), told.cast(pa.string()), run.cast(pa.string()), pa.array(counts, pa.int64())], ["part", "lang", "run", "n"]))
                if sum(x.nbytes for x in held) >= GATHERED:
                    held = [_summed(held)]
                    if 2 * held[0].nbytes >= GATHERED:
                        yield _packed_runs(held.pop())
                pa.default_memory_pool().release_unused()
        if held:
            yield _packed_runs(_summed(held))

    packed = _named(docs, text, lang).mapInArrow(count, "lang string, part int, runs string, counts array<long>").repartition("lang", "part")
    told = packed.select("lang", "part", F.inline(F.arrays_zip(F.split("runs", "\n").alias("run"), F.col("counts").alias("n"))))
    # Rows of a part are together already, so this needs no other exchange.
    counted = told.groupBy("lang", "part", "run").agg(F.sum("n").alias("n"))
    return counted.select("lang", "run", (F.length("run") - F.length(F.replace("run", F.lit(" "), F.lit(""))) + 1).alias("size"), "n")


def graph(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> PhraseGraph:
    """The graph of whole texts, with all counts of `least` and more, and those of single words. Each level is derived from the one above it and the pieces' ends, and written once."""
    edges = stored(runs(docs, text, lang, longest, least))
    levels = {longest: edges.where(F.col("size") == longest).select("lang", "run", "n")}
    for k in range(longest - 1, 0, -1):
        flow = levels[k + 1].select("lang", _first(F.col("run"), k).alias("run"), "n")
        ends = edges.where(F.col("size") == k).select("lang", "run", "n")
        levels[k] = stored(flow.unionByName(ends).groupBy("lang", "run").agg(F.sum("n").alias("n")))
    return PhraseGraph(levels, levels[1].groupBy("lang").agg(F.sum("n").alias("n")), longest)


def compacted(found: PhraseGraph, least: int = LEAST) -> DataFrame:
    """(lang, words, n): paths that together hold every edge of `least` and more once; the edges of a path share its weight."""
    size = found.longest
    nodes = found.levels[size - 1].where(F.col("n") >= least)
    edges = found.levels[size].where(F.col("n") >= least).select("lang", _first(F.col("run"), size - 1).alias("tail"), _rest(F.col("run"), size, 1).alias("head"), "n")
    weights = edges.join(nodes.select("lang", F.col("run").alias("tail"), F.col("n").alias("tail_n")), ["lang", "tail"])
    weighed = stored(weights.join(nodes.select("lang", F.col("run").alias("head"), F.col("n").alias("head_n")), ["lang", "head"]))
    # An edge goes on into the next one where the node between them has no other flow: it weighs as much as the node.
    inner = weighed.where("n = head_n").select("lang", "tail", "head")
    onward = inner.join(weighed.where("n = tail_n").select("lang", F.col("tail").alias("head"), F.col("head").alias("next")), ["lang", "head"])
    # An edge is known by both nodes. `to` is an edge further on, `far` how far; an edge that nothing follows is not in here.
    ahead = stored(onward.select("lang", _edge("tail", "head").alias("edge"), _edge("head", "next").alias("to"), F.lit(1).cast("long").alias("far")))
    while True:
        hop = ahead.select("lang", F.col("edge").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        met = ahead.join(hop, ["lang", "to"], "left")
        ahead = stored(met.select("lang", "edge", F.coalesce("beyond", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("beyond").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            break
    every = weighed.select("lang", _edge("tail", "head").alias("edge"), "n")
    told = every.join(ahead.select("lang", "edge", "to", "far"), ["lang", "edge"], "left").select("lang", "n", "edge", F.coalesce("to", "edge").alias("last"), F.coalesce("far", F.lit(0)).alias("far"))
    # A path lies within a piece of some text, and its edges are put together from the one farthest from its end.
    gathered = told.groupBy("lang", "last", "n").agg(F.sort_array(F.collect_list(F.struct("far", "edge")), asc=False).alias("edges"))
    first = F.split(F.get("edges", F.lit(0))["edge"], " ")
    more = F.transform(F.slice("edges", 2, F.size("edges")), lambda e: F.substring_index(e["edge"], " ", -1))
    return gathered.select("lang", F.concat(first, more).alias("words"), "n")


def _edge(tail: str, head: str) -> Column:
    return F.concat(F.col(tail), F.lit(" "), F.substring_index(F.col(head), " ", -1))


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a * a / (l * r)), by whole numbers of up to 38 digits: exact for counts below 10^16."""
    whole = [c.cast("decimal(20,0)") for c in (a, l, r)]
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (whole[0] * whole[0]), whole[1] * whole[2])


def _scored(phrases: DataFrame, found: PhraseGraph, least: int) -> DataFrame:
    """`phrases` (lang, phrase, a) with l, r and score of their lowest-scoring cut. Parts are at least as frequent as what they are parts of."""
    counts = None
    for k in range(1, found.longest):
        level = found.levels[k].where(F.col("n") >= least).select("lang", "run", "n")
        counts = level if counts is None else counts.unionByName(level)
    words = F.split("phrase", " ")
    told = phrases.select("lang", "phrase", "a", words.alias("words"))
    cut = told.select("lang", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    parts = cut.select("lang", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("right"))
    both = parts.join(counts.select("lang", F.col("run").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("run").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    lowest = both.groupBy("lang", F.concat("left", F.lit(" "), "right").alias("phrase"), "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(found: PhraseGraph, least: int = LEAST, top: int = TOP, held: int = HELD_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two words and more."""
    size = found.longest
    paths = stored(compacted(found, least).withColumnRenamed("words", "path"))
    inside = F.transform(F.sequence(F.lit(1), F.size("path") - size + 1), lambda i: F.array_join(F.slice("path", i, F.lit(size)), " "))
    phrases = paths.select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("a"))
    every = above = phrases
    for k in range(size - 1, 1, -1):
        level = found.levels[k].where(F.col("n") >= least).select("lang", F.col("run").alias("phrase"), F.col("n").alias("a"))
        # The heaviest phrase of one word more around each; a still longer one that holds it is no heavier.
        around = F.explode(F.array(_first(F.col("phrase"), k), _rest(F.col("phrase"), k + 1, 1)))
        heaviest = above.select("lang", F.col("a").alias("longer"), around.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        own = level
        if k == size - 1:
            interior = F.transform(F.sequence(F.lit(2), F.size("path") - size + 1), lambda i: F.array_join(F.slice("path", i, F.lit(k)), " "))
            within = paths.where(F.size("path") > size).select("lang", F.explode(interior).alias("phrase"))
            own = level.join(within, ["lang", "phrase"], "left_anti")
        own = own.join(heaviest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < held * F.col("a")))
        every = every.unionByName(own.select("lang", "phrase", "a"))
        above = level
    scored = _scored(every, found, least)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(found.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
