"""Sequence-matching similarity, which no built-in function equals: Arrow functions over the standard library's matcher.

They are kept to bounded inputs (titles, vocabulary terms, evaluation pairs) behind cheap prefilters, none of which turns away
a pair that the matcher would accept.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from pagemill.session import ensure_checkpoint_dir

TITLE_RATIO = 0.6
CONTAINED_LEAST = 6
#: Titles of a block, at the least where there are enough for `FEW_BLOCKS` and at the most; blocks meet blocks.
BLOCK, FEW_BLOCKS, BLOCK_MOST = 2048, 8, 16_384
#: Characters of titles that are compared with others at a time.
CHARS = 1_000_000


@F.pandas_udf(DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The matcher's ratio of two strings; not symmetric, and null for nulls."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def similarity(predicted: Column, truth: Column) -> Column:
    """Ratio of two normalised texts, the first cut to the length of the second."""
    return ratio(F.substring(predicted, F.lit(1), F.length(truth)), truth)


def titles_match(a: str | None, b: str | None) -> bool:
    """Two normalised titles name the same work: one holds the other at word borders, or they are alike enough."""
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) >= CONTAINED_LEAST and re.search(rf"(?:^|\s){re.escape(short)}(?:\s|$)", long):
        return True
    return difflib.SequenceMatcher(None, a, b).ratio() >= TITLE_RATIO


@F.pandas_udf(BooleanType())
def same_title(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([titles_match(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each letter occurs in each word; rarer characters share counters, which keeps the bound a bound."""
    counts = np.zeros((len(words), 64), np.int16)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    np.add.at(counts, (owner, points & 63), 1)
    return counts


def gram_codes(words: list[str], q: int) -> list[np.ndarray]:
    """The grams of q characters (two, three, or 0 for none) of each word as numbers. A gram's second place in a word is another number than its first, so two words
    share as many numbers as grams; equal numbers of different grams can but add to that."""
    owner, points = _points(words)
    ends = len(points) - q + 1
    if ends <= 0 or not q:
        return [np.zeros(0, np.uint64) for _ in words]
    codes = np.zeros(ends, np.uint64)
    for i in range(q):
        codes = (codes << np.uint64(21)) | points[i : i + ends]
    whole = owner[:ends] == owner[q - 1 :]
    owner, codes = owner[:ends][whole], codes[whole]
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    place, new = np.arange(len(codes)), np.ones(len(codes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])
    times = place - np.maximum.accumulate(np.where(new, place, 0))
    codes = (codes ^ (times.astype(np.uint64) << np.uint64(48))) * np.uint64(0x9E3779B97F4A7C15)
    return np.split(codes, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of its word, code point) of every character."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return owner, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Held:
    """Words that others are compared with, all at a time."""

    def __init__(self, words: list[str], q: int) -> None:
        self.q, self.sizes, self.counts = q, np.fromiter(map(len, words), np.int64, len(words)), letter_counts(words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.alphabet, letters = np.unique(_points(words)[1], return_inverse=True)
        self.letters = letters.astype(np.int32)
        told = gram_codes(words, q)
        codes, owner = np.concatenate([np.zeros(0, np.uint64), *told]), np.repeat(np.arange(len(words)), [len(x) for x in told])
        order = np.argsort(codes, kind="stable")
        # For each gram the words that have it.
        self.grams, bounds = np.unique(codes[order], return_index=True)
        self.bounds, self.owner = np.append(bounds, len(codes)), owner[order]
        self.needs: dict[tuple[float, int], np.ndarray] = {}

    def shared(self, codes: np.ndarray) -> np.ndarray:
        """How many grams a word, of these `gram_codes`, shares with each word."""
        at = np.searchsorted(self.grams, codes)
        inside = at < len(self.grams)
        at = at[inside][self.grams[at[inside]] == codes[inside]]
        lists = [self.owner[a:b] for a, b in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), np.int64)

    def needed(self, least: float, size: int) -> np.ndarray:
        """How many grams a word of `size` characters must share with each word to reach the ratio `least`: 0 where none is sure to be shared, more than
        there are where the lengths rule it out."""
        if (least, size) not in self.needs:
            sizes = np.arange(self.sizes.max(initial=0) + 1)
            need = np.maximum(np.ceil(least_shared(least, (size + sizes).astype(float), self.q) - 1e-9), 0) if self.q else 0
            self.needs[least, size] = np.where(2 * np.minimum(size, sizes) >= least * (size + sizes) - 1e-9, need, size + 1).astype(np.int64)
        return self.needs[least, size][self.sizes]

    def common_subsequence(self, word: str, near: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of a word of up to 64 characters with the words at `near`, bit-parallel over them."""
        masks = np.zeros(len(self.alphabet) + 1, np.uint64)
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        np.bitwise_or.at(masks, np.where(np.isin(points, self.alphabet), np.searchsorted(self.alphabet, points), len(self.alphabet)), np.uint64(1) << np.arange(len(word), dtype=np.uint64))
        masks[-1] = 0
        free, starts, sizes = np.full(len(near), 2**64 - 1, np.uint64), self.starts[near], self.sizes[near]
        for j in range(int(sizes.max(initial=0))):
            row = np.where(j < sizes, masks[self.letters[np.minimum(starts + j, len(self.letters) - 1)]], np.uint64(0))
            met = free & row
            free = (free + met) | (free - met)
        return np.bitwise_count(~free & np.uint64((1 << len(word)) - 1)).astype(np.int64)

    def could_match(self, word: str, counts: np.ndarray, codes: np.ndarray, least: float) -> np.ndarray:
        """Places of the words whose ratio with `word`, of these `letter_counts` and `gram_codes`, may reach `least`. Matching characters are common letters in
        common order, in blocks that leave grams whole, so none of the bounds turns away a pair that reaches it."""
        near = np.flatnonzero((self.shared(codes) if self.q else 0) >= self.needed(least, len(word)))
        least_common = least * (self.sizes[near] + len(word)) - 1e-9
        kept = 2 * np.minimum(self.counts[near], counts).sum(axis=1, dtype=np.int32) >= least_common
        near, least_common = near[kept], least_common[kept]
        return near[2 * self.common_subsequence(word, near) >= least_common] if len(near) and len(word) <= 64 else near


def least_shared(least: float, size: Column | float, q: int) -> Column | float:
    """How many grams of q characters two titles of `size` characters together share at the least if their ratio is `least`.

    Of `size` characters 2 M are matched, M of at least least * size / 2, in blocks that are parted by at least one of the size - 2 M others, so in at
    most size - 2 M + 1 blocks; a block of n characters has n - q + 1 grams. At a ratio of 2/3 and below this is nothing for any q from 2 on.
    """
    return ((2 * q - 1) * least / 2 - (q - 1)) * size - (q - 1)


GRAM = 3
#: Above this ratio titles must share grams of three characters.
GRAM_RATIO = 0.8


def _block_count(n: int) -> int:
    """Blocks of n titles: a few if there are enough titles, so that all cores have some, and more as they would grow over `BLOCK_MOST`."""
    return max(1, -(-n // BLOCK_MOST), min(-(-n // BLOCK), FEW_BLOCKS))


def slices(words: list[str], most: int) -> Iterator[slice]:
    """Stretches of words of up to `most` characters together, or of one word."""
    first, chars = 0, 0
    for i, word in enumerate(words):
        if i > first and chars + len(word) > most:
            yield slice(first, i)
            first, chars = i, 0
        chars += len(word)
    if first < len(words):
        yield slice(first, len(words))


def block_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): ids of titles (id, title) whose ratio may be `least`, blocks with blocks of lengths that can match.

    Above `GRAM_RATIO` the grams that two titles share are counted by an index of a block, in the task that has it. Common letters and then common
    subsequences are counted for whole blocks at a time; what they leave is nearly all alike. Nothing but titles is sent between tasks.
    """
    ensure_checkpoint_dir(left.sparkSession)
    q = GRAM if least > GRAM_RATIO else 0

    def blocks(titles: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = _block_count(titles.count())
        # Blocks of like lengths: a block is a stretch of the lengths' quantiles.
        steps = titles.agg(F.percentile_approx(F.length("title"), [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
        low = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x < F.length("title"))) if steps else F.lit(0)
        high = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= F.length("title"))) if steps else F.lit(0)
        number = low + F.pmod(F.xxhash64("title"), (high - low + 1).cast("long")).cast("int")
        told = titles.groupBy(number.alias(name)).agg(F.collect_list(F.struct("id", "title")).alias(f"{name}s"), F.min(F.length("title")).alias(f"{name}_least"), F.max(F.length("title")).alias(f"{name}_most"))
        return told.checkpoint(), n

    (a, n), (b, m) = blocks(left, "a"), blocks(right, "b")
    fits = (F.col("a_most") >= F.lit(least / (2 - least)) * F.col("b_least")) & (F.col("b_most") >= F.lit(least / (2 - least)) * F.col("a_least"))
    meet = a.select("a", "a_least", "a_most", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b")).join(b.drop("bs"), "b").where(fits).select("a", "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, others in zip(frame["as"], frame["bs"], strict=True):
                (keys, names), (ids, titles) = ([[r[c] for r in side] for c in ("id", "title")] for side in (own, others))
                for some in slices(titles, CHARS):
                    held, rows = Held(titles[some], q), []
                    for own_ in slices(names, CHARS):
                        for key, title, counts, codes in zip(keys[own_], names[own_], letter_counts(names[own_]), gram_codes(names[own_], q), strict=True):
                            rows += [(key, ids[some.start + i]) for i in held.could_match(title, counts, codes, least).tolist()]
                    yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    # A row is two blocks; they are dealt out once more, or a block's rows would be one task.
    dealt = meet.join(a.select("a", "as"), "a").join(b.select("b", "bs"), "b").repartition(max(8, min(n * m, 10_000)), "a", "b")
    return dealt.select("as", "bs").mapInPandas(run, "a long, b long")


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): ids of titles of which one holds the other at word borders, by the rarest word of the shorter one."""

    def worded(titles: DataFrame) -> DataFrame:
        return titles.select("id", F.explode(F.array_distinct(F.split("title", " "))).alias("word"), F.length("title").alias("size"))

    def held(short: DataFrame, long: DataFrame) -> DataFrame:
        all_words = worded(long)
        df = all_words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        rarest = worded(short).where(F.col("size") >= CONTAINED_LEAST).join(df, "word", "left").groupBy("id", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("rare")).where("rare.df > 0")
        met = rarest.select(F.col("id").alias("s"), F.col("size").alias("s_size"), F.col("rare.word").alias("word")).join(all_words.select("word", F.col("id").alias("l"), F.col("size").alias("l_size")), "word").where("s_size <= l_size")
        texts = met.join(short.select(F.col("id").alias("s"), F.col("title").alias("s_title")), "s").join(long.select(F.col("id").alias("l"), F.col("title").alias("l_title")), "l")
        return texts.where(F.concat(F.lit(" "), "l_title", F.lit(" ")).contains(F.concat(F.lit(" "), "s_title", F.lit(" ")))).select("s", "l")

    return held(left, right).select(F.col("s").alias("a"), F.col("l").alias("b")).unionByName(held(right, left).select(F.col("l").alias("a"), F.col("s").alias("b")))


def _anchors(words: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of its word, hash) of the anchors of each word: for every stretch of `least` characters the gram in it with the smallest hash. A word
    within another has no other anchors than that one."""
    q = max(1, 3 * least // 5)
    owner, points = _points(words)
    ends = len(points) - q + 1
    if ends <= least - q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.zeros(ends, np.uint64)
    for i in range(q):
        codes = codes * np.uint64(0x100000001B3) + points[i : i + ends] + np.uint64(1)
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(32)
    stretches = ends - (least - q)
    low = codes[:stretches].copy()
    for i in range(1, least - q + 1):
        np.minimum(low, codes[i : i + stretches], out=low)
    whole = owner[:stretches] == owner[least - 1 : least - 1 + stretches]
    owner, low = owner[:stretches][whole], low[whole]
    new = np.ones(len(low), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])
    return owner[new], low[new].view(np.int64)


def anchored(titles: DataFrame, least: int) -> DataFrame:
    """(id, anchor) of titles (id, title) of `least` characters and more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, words = frame["id"].to_numpy(), frame["title"].tolist()
            for some in slices(words, CHARS):
                owner, codes = _anchors(words[some], least)
                yield pd.DataFrame({"id": ids[some][owner], "anchor": codes}).drop_duplicates()

    return titles.where(F.length("title") >= least).select("id", "title").mapInPandas(run, "id long, anchor long")


def _with_texts(met: DataFrame, short: DataFrame, long: DataFrame) -> DataFrame:
    """Of pairs (s, l) those whose long title holds the short one."""
    texts = met.join(short.select(F.col("id").alias("s"), F.col("title").alias("s_title")), "s").join(long.select(F.col("id").alias("l"), F.col("title").alias("l_title")), "l")
    return texts.where(F.col("l_title").contains(F.col("s_title"))).select("s", "l")


def _both_ways(held: Callable[[DataFrame, DataFrame], DataFrame], left: DataFrame, right: DataFrame) -> DataFrame:
    return held(left, right).select(F.col("s").alias("a"), F.col("l").alias("b")).unionByName(held(right, left).select(F.col("l").alias("a"), F.col("s").alias("b")))


def text_pairs(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(a, b): ids of titles of which one, of `least` characters and more, stands in the other, by the rarest anchor of the shorter one."""

    def held(short: DataFrame, long: DataFrame) -> DataFrame:
        most = long.agg(F.max(F.length("title"))).first()[0] or 0
        asked, told = anchored(short.where(F.length("title") <= most), least), anchored(long, least)
        df = told.join(asked.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("df"))
        # A title one of whose anchors is in no other stands in none.
        rarest = asked.join(df, "anchor", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("rare")).where("rare.df > 0")
        return _with_texts(rarest.select(F.col("id").alias("s"), F.col("rare.anchor").alias("anchor")).join(told.select("anchor", F.col("id").alias("l")), "anchor").select("s", "l"), short, long)

    return _both_ways(held, left, right)


def part_pairs(left: DataFrame, right: DataFrame, least: int, most: int, share: float) -> DataFrame:
    """(a, b): ids of titles of which one, of `least` to `most` characters and at least `share` of the other's, stands in the other: by all parts of
    such lengths, of which a title has few if the share is large."""

    def held(short: DataFrame, long: DataFrame) -> DataFrame:
        size = F.length("title")
        sizes = F.sequence(F.greatest(F.lit(least), F.ceil(size * F.lit(share) - 1e-9)).cast("int"), F.least(F.lit(most), size))
        parts = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(F.col("title"), at, n))))
        told = long.where((size >= least) & (size * F.lit(share) <= most + 1e-9)).select(F.col("id").alias("l"), F.explode(F.array_distinct(parts)).alias("part"))
        return short.where(size.between(least, most)).select(F.col("id").alias("s"), F.col("title").alias("part")).join(told, "part").select("s", "l")

    return _both_ways(held, left, right)


def pair_candidates(left: DataFrame, right: DataFrame, least: float, holding: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates (a, b), left (id, title), right (id, title)) of different titles: all pairs that may reach the ratio `least`, and those of `holding`."""
    ensure_checkpoint_dir(left.sparkSession)
    own, others = (side.select("title").where("title is not null and title <> ''").distinct().select(F.monotonically_increasing_id().alias("id"), "title").checkpoint() for side in (left, right))
    if least > GRAM_RATIO:
        most = own.agg(F.max(F.length("title"))).first()[0] or 0
        found = block_pairs(own, others.where(F.length("title") <= most * (2 - least) / least), least)
    else:
        found = block_pairs(own, others, least)
    if holding is not None:
        found = found.unionByName(holding(own, others))
    return found.distinct(), own, others


def title_pairs(left: DataFrame, right: DataFrame, least: float, judge: Callable[[str, str], float | bool], holding: Callable[[DataFrame, DataFrame], DataFrame] | None = word_pairs) -> DataFrame:
    """(a, b, score) of different titles `left` (title) and `right` (title) whose ratio may reach `least`, or that `holding` finds one within the
    other, and for which `judge` gives other than nothing. No pair that `judge` would accept is lost."""
    found, own, others = pair_candidates(left, right, least, holding)
    told = found.join(own.select(F.col("id").alias("a"), F.col("title").alias("a_title")), "a").join(others.select(F.col("id").alias("b"), F.col("title").alias("b_title")), "b").select(F.col("a_title").alias("a"), F.col("b_title").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [float(judge(a, b)) for a, b in zip(frame["a"], frame["b"], strict=True)]
            out = frame.assign(score=np.array(scores, float))
            yield out[out["score"] > 0]

    return told.mapInPandas(run, "a string, b string, score double")
