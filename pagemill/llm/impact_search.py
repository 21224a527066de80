"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

A block of vectors is indexed as posting segments (impact level, dimension): the level of a component is the bit
length of its absolute value. A search adds up segments from the highest level down for a sub-block of queries at once. What
is still missing of a score is at most the query's norm times the norm of the vector's unread components, which the
index keeps per level. Reading stops only when that bound proves few vectors able to reach the k-th best exact score
found so far; those possible members are rescored exactly in integers, so results are exact wherever reading stops.

Each vector block is shipped and indexed once; query blocks, which are few beside the vectors, are streamed past it in
sorted order, so a task holds one index and one query block. In a first round a query block meets one vector block only,
which gives every query a floor, the k-th best score there; in the second it meets all, and its floor ends the reading early
and keeps all but the rows that reach it out of the shuffle.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id; shorter vectors
count as padded with zeros; rows that share the query's id are its own row and no candidates; ties go to the smaller id; a
query with fewer candidates than k returns them all; an empty table gives an empty one. Products are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import stored

SCALE = 64
QUERY_BLOCK = 512
VECTOR_BLOCK = 8192
SUB_BLOCK = 256
#: Reading stops at a proof that leaves at most this share of a block's vectors to be rescored.
RESCORED_SHARE = 0.05
PAIRS = 40_000


class ImpactIndex:
    """Posting segments of a block of integer vectors, by descending level."""

    def __init__(self, values: np.ndarray):
        self.values = values
        size = np.abs(values)
        level = np.zeros(values.shape, np.int8)
        level[size > 0] = np.floor(np.log2(size[size > 0])).astype(np.int8) + 1
        self.levels = sorted(np.unique(level[level > 0]).tolist(), reverse=True)
        self.segments, self.unread = [], []
        left = (values.astype(np.float64) ** 2).sum(axis=1)
        for which in self.levels:
            here = level == which
            self.segments.append([(d, rows := np.flatnonzero(here[:, d]), values[rows, d].astype(np.float32)) for d in np.flatnonzero(here.any(axis=0)).tolist()])
            left = left - np.where(here, values.astype(np.float64) ** 2, 0).sum(axis=1)
            self.unread.append(np.sqrt(np.maximum(left, 0)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): all rows that may be among the k best of each query, `own` pairs left out, exactly scored. Rows that
        cannot reach the query's `floor` may be left out too."""
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        n, m = len(self.values), len(queries)
        total = np.zeros((n, m), np.float32)
        columns = queries.T.astype(np.float32)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        # Room for what single precision rounds off in sums of this size.
        slop = 1e-5 * norms * np.sqrt((self.values.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) + 1
        everything = ~own
        if n <= 4 * k or not self.levels:
            return self._rescored(queries, everything)
        for number, segments in enumerate(self.segments):
            for d, rows, values in segments:
                total[rows] += values[:, None] * columns[d][None, :]
            last = number == len(self.segments) - 1
            if not last and self.unread[number].max() * norms.max() > total.std() * 4:
                continue
            possible = self._possible(queries, total, own, norms, slop, number, k, floor)
            if last or possible.mean() <= RESCORED_SHARE:
                return self._rescored(queries, possible)
        return self._rescored(queries, everything)

    def _possible(self, queries, total, own, norms, slop, number, k, floor) -> np.ndarray:
        """Rows whose bound reaches the floor and the k-th best exact score among the k rows that lead so far."""
        led = np.where(own, -np.inf, total)
        top = np.argpartition(-led, k - 1, axis=0)[:k]
        exact = np.einsum("kmd,md->km", self.values[top].astype(np.int64), queries.astype(np.int64)).astype(np.float64)
        exact[np.take_along_axis(own, top, axis=0)] = -np.inf
        floor = np.maximum(floor, exact.min(axis=0))
        return ~own & (total + self.unread[number][:, None] * norms[None, :] + slop[None, :] >= floor[None, :])

    def _rescored(self, queries: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, row = np.nonzero(possible.T)
        score = np.empty(len(row), np.int64)
        for at in range(0, len(row), PAIRS):
            part = slice(at, at + PAIRS)
            score[part] = np.einsum("pd,pd->p", self.values[row[part]].astype(np.int64), queries[query[part]].astype(np.int64))
        return query, row, score


def best(index: ImpactIndex, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> pd.DataFrame:
    """The k best rows of one block for every query, of those that reach the query's floor: query_id, vec_id, score."""
    parts = []
    for at in range(0, len(queries), SUB_BLOCK):
        some = slice(at, at + SUB_BLOCK)
        block, names, least = queries[some], query_ids[some], np.full(len(queries[some]), -np.inf) if floor is None else floor[some]
        query, row, score = index.search(block, ids[:, None] == names[None, :], k, least)
        reach = score >= least[query]
        query, row, score = query[reach], row[reach], score[reach]
        order = np.lexsort((ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, np.arange(len(block)))
        kept = np.arange(len(query)) - first[query] < k
        parts.append(pd.DataFrame({"query_id": names[query[kept]], "vec_id": ids[row[kept]], "score": score[kept]}))
    return pd.concat(parts, ignore_index=True)


def _integer(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))


def _blocks(rows: DataFrame, blocks: int, columns: dict[str, Column]) -> DataFrame:
    """`rows` (id, vector, ...) dealt evenly into numbered blocks of bounded size: the number, and `columns` of their collected rows."""
    dealt = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("block"), F.struct(*rows.columns).alias("row"))
    return dealt.groupBy("block").agg(F.collect_list("row").alias("rows")).select("block", *[c.alias(n) for n, c in columns.items()])


def _arrays(*more: str) -> dict[str, Column]:
    """Ids, vector lengths, components one after another, and further fields of the collected rows."""
    of = lambda field: F.transform("rows", lambda r: r[field])
    return {"ids": of("id"), "sizes": F.transform("rows", lambda r: F.size(r["vector"])), "flat": F.flatten(of("vector")), **{m: of(m) for m in more}}


def _met(held: DataFrame, asking: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of vector blocks `held` (block, ...) for the query blocks `asking` (block, number, ...)."""
    ahead = held.select("block", F.lit(-1).alias("number"), "ids", "sizes", "flat", F.lit(None).cast("array<double>").alias("floor"))
    streamed = ahead.unionByName(asking.select(*ahead.columns)).repartition(blocks, "block").sortWithinPartitions("block", "number")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ids = block = None
        for frame in frames:
            for row in frame.itertuples():
                values = _matrix(row.sizes, row.flat)
                if row.number < 0:
                    index, ids, block = ImpactIndex(values), np.asarray(row.ids), row.block
                    continue
                if row.block != block:  # a block without vectors
                    continue
                width = index.values.shape[1]
                if values.shape[1] > width:  # components beyond all vectors of the block add nothing
                    values = values[:, :width]
                values = np.pad(values, ((0, 0), (0, width - values.shape[1])))
                floor = None if row.floor is None else np.asarray(row.floor, float)
                yield best(index, ids, np.asarray(row.ids), values, k, floor)

    return streamed.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")


def _matrix(sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Rows of the given lengths, padded with zeros to the longest."""
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows with the highest inner products with each query row."""
    told = vectors.where(_usable(F.col(vector)) & F.col(key).isNotNull())
    rows, asked = (x.select(F.col(key).cast("long").alias("id"), _integer(F.col(vector), scale).alias("vector")) for x in (told, told.where(is_query)))
    n, m = (x.agg(F.count(F.lit(1))).first()[0] for x in (told, told.where(is_query)))
    v, q = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    held = stored(_blocks(rows, v, _arrays()))
    if v == 1:
        asking = _blocks(asked, q, _arrays()).withColumn("floor", F.lit(None).cast("array<double>"))
    else:
        home = _blocks(asked, q, _arrays()).withColumn("floor", F.lit(None).cast("array<double>")).select(F.pmod("block", F.lit(v)).cast("int").alias("block"), F.col("block").alias("number"), "ids", "sizes", "flat", "floor")
        # The k-th best of one block: a floor of the k-th best of all.
        floors = _met(held, home, v, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
        floored = asked.join(floors, "id", "left").select("id", "vector", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("floor"))
        asking = _blocks(floored, q, _arrays("floor"))
    every = asking.select(F.explode(F.sequence(F.lit(0), F.lit(v - 1))).alias("block"), F.col("block").alias("number"), "ids", "sizes", "flat", "floor")
    met = _met(held, every, v, k)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
