"""SimHash near-duplicates, linked through BK-trees.

Fingerprints within the radius agree on at least two of five bit blocks, so every pair of blocks gives a shard key and
every close pair meets in some shard. A shard's fingerprints form a BK-tree: children hang from their parent by their
integer Hamming distance to it, and a search follows only edges within the radius of the distance it has seen. Trees and
searches of all shards in a batch advance level by level as arrays.

Equal fingerprints are one node from the start, so groups of copies never become pairs. Shards above `SHARD` members
are split; each part's tree is sent to the other parts of the same key and to no others, through an equi-join on
key and part: that takes the place of a broadcast of all trees, which would grow with the corpus. A shard passes on
only a spanning forest of its links, and components are contracted from those.

Defined results: a null text counts as empty, a text without words has fingerprint zero and links like any other;
component_id is the least doc_id of the component, nulls aside (null if all ids are null); repeated rows are members
like any other; an empty table gives an empty one. `one_of_each` keeps the row with that least id, and one of rows that
agree in id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagemill.llm.common import packed
from pagemill.llm.components import least_members
from pagemill.session import ensure_checkpoint_dir

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = (13, 13, 13, 13, 12)
SHARD = 2048
BATCH_POINTS = 100_000
FRONTIER = 500_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of the runs of `shingle` words of a text in order; one of all words if there are fewer, none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    width = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text as an unsigned number."""
    return majority(np.array(shingle_hashes(text, shingle, seed), "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where over half of the hashes (little-endian 64-bit) have them set; 0 for no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *carried: Column, text: str = "text", of: Callable[[str | None], int] = simhash) -> DataFrame:
    """`carried` columns and the fingerprint of every text, as a bigint of the same bits."""
    named = docs.select(*[c.alias(f"carried_{i}") for i, c in enumerate(carried)], F.col(text).alias("text"))
    schema = StructType([*[f for f in named.schema.fields if f.name != "text"], StructField("print", LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns="text")
            out["print"] = np.array([of(t) for t in frame["text"]], np.uint64).view(np.int64)
            yield out

    return named.mapInPandas(run, schema)


def shard_keys(value: Column, radius: int = RADIUS) -> Column:
    """One key for each choice of blocks that a pair within the radius may agree on."""
    keep = len(BLOCKS) - radius
    starts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), keep)):
        key = F.lit(number).cast("long")
        for b in chosen:
            key = F.shiftleft(key, BLOCKS[b]).bitwiseOR(F.shiftrightunsigned(value, starts[b]).bitwiseAND(F.lit((1 << BLOCKS[b]) - 1)))
        keys.append(key)
    return F.array(*keys)


def forest(prints: np.ndarray, shard: np.ndarray, met: list[np.ndarray] | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards: (the root of each shard, sorted edge keys parent * 65 + distance, children).

    Points of a shard must differ and lie side by side; the first is the root. All points that reach a node do so in
    the same round, so the first of each (node, distance) becomes the child and the others move on to it. `met`, if given,
    takes for each point the nearest node on its way down, of another label if points have labels, the first of equals, and the
    distance to it (65 for none).
    """
    roots = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    pending = np.ones(len(prints), bool)
    pending[roots] = False
    point = np.flatnonzero(pending)
    node = roots[np.searchsorted(roots, point, side="right") - 1]
    keys, children = [], []
    nearest, least = np.arange(len(prints)), np.full(len(prints), 65)
    while len(point):
        distance = np.bitwise_count(prints[point] ^ prints[node]).astype(np.int64)
        closer = distance < least[point]
        if label is not None:
            closer &= label[point] != label[node]
        nearest[point[closer]], least[point[closer]] = node[closer], distance[closer]
        edge = node * 65 + distance
        found, first, back = np.unique(edge, return_index=True, return_inverse=True)
        keys.append(found)
        children.append(point[first])
        stay = np.ones(len(point), bool)
        stay[first] = False
        point, node = point[stay], point[first][back][stay]
    keys, children = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*children, np.zeros(0, np.int64)])
    order = np.argsort(keys)
    if met is not None:
        met += [nearest, least]
    return roots, keys[order], children[order]


def within(queries: np.ndarray, start: np.ndarray, prints: np.ndarray, keys: np.ndarray, children: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) pairs at distance `radius` or less, searching from each query's root, in bounded pieces."""
    todo = [(np.arange(len(queries)), start)]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            half = len(query) // 2
            todo += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        distance = np.bitwise_count(queries[query] ^ prints[node]).astype(np.int64)
        close = distance <= radius
        if close.any():
            yield query[close], node[close]
        low = np.searchsorted(keys, node * 65 + np.maximum(distance - radius, 0))
        high = np.searchsorted(keys, node * 65 + np.minimum(distance + radius, 64) + 1)
        size = high - low
        if size.any():
            ends = np.cumsum(size)
            at = np.repeat(low - (ends - size), size) + np.arange(int(ends[-1]))
            todo.append((np.repeat(query, size), children[at]))


def _least_labels(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n points the least point that the pairs connect it to."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = (np.concatenate([p[i] for p in pairs]) for i in range(2))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(trees: list[np.ndarray], others: list[np.ndarray | None], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each shard: among the points of its tree, or between them and those of `others`."""
    sizes = np.array([len(t) for t in trees], np.int64)
    prints = np.concatenate(trees)
    shard = np.repeat(np.arange(len(trees)), sizes)
    roots, keys, children = forest(prints, shard)
    searched = [t if o is None else o for t, o in zip(trees, others, strict=True)]
    counts = np.array([len(s) for s in searched], np.int64)
    queries = np.concatenate(searched)
    own = np.array([o is None for o in others])
    # Queries that are points of their own tree are those points; the rest are numbered after all points.
    number = np.arange(len(queries)) + len(prints)
    inner = np.repeat(own, counts)
    number[inner] = np.flatnonzero(np.repeat(own, sizes))
    pairs = [(number[q], p) for q, p in within(queries, np.repeat(roots, counts), prints, keys, children, radius)]
    everything = np.concatenate((prints, queries))
    label = _least_labels(len(everything), pairs)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return everything[linked], everything[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect what lies within the radius; `prints` has distinct values in the column print."""
    members = prints.select("print", F.explode(shard_keys(F.col("print"), radius)).alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(shard)).cast("int")
    shared = members.join(sizes, "key").select("key", "print", parts.alias("parts")).withColumn("part", F.expr("pmod(xxhash64(print), parts)").cast("int"))
    groups = shared.groupBy("key", "part", "parts").agg(F.collect_list("print").alias("tree"))
    none = F.lit(None).cast("array<bigint>")
    inside = groups.select("tree", none.alias("other"))
    split = groups.where("parts > 1")
    sent = split.select("key", "tree", F.explode(F.expr("sequence(0, parts - 1)")).alias("to"), "part").where("to > part")
    across = sent.join(split.select("key", F.col("part").alias("to"), F.col("tree").alias("other")), ["key", "to"]).select("tree", "other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            trees, others, size = [], [], 0
            for tree, other in zip(frame["tree"], frame["other"], strict=True):
                trees.append(np.asarray(tree, np.int64).view(np.uint64))
                others.append(None if other is None else np.asarray(other, np.int64).view(np.uint64))
                size += len(trees[-1]) + (0 if other is None else len(other))
                if size > BATCH_POINTS:
                    yield _frame(*shard_links(trees, others, radius))
                    trees, others, size = [], [], 0
            if trees:
                yield _frame(*shard_links(trees, others, radius))

    def _frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return inside.unionByName(across).mapInPandas(run, "a bigint, b bigint")


def identity(key: str, text: str) -> Column:
    """What tells rows apart: the id, nulls last, and a digest of the text."""
    return F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"))


def _least_of_class(rows: DataFrame, radius: int) -> DataFrame:
    """(print, least identity of its component) for every print of `rows` (print, identity)."""
    distinct = rows.groupBy("print").agg(F.min("identity").alias("first")).checkpoint()
    roots = least_members(links(distinct.select("print"), radius))
    members = roots.select(F.col("node").alias("print"), "root").unionByName(roots.select(F.col("root").alias("print"), "root").distinct())
    firsts = members.join(distinct, "print").groupBy("root").agg(F.min("first").alias("least"))
    merged = members.join(firsts, "root").select("print", "least")
    return distinct.join(merged, "print", "left").select("print", F.coalesce("least", "first").alias("least"))


def classes(docs: DataFrame, *carried: Column, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`carried` columns, then print (the fingerprint's bits as a bigint) and component_id of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    names = [f"carried_{i}" for i in range(len(carried))]
    rows = fingerprints(docs, *carried, identity(key, text), text=text).withColumnRenamed(f"carried_{len(carried)}", "identity").checkpoint()
    return rows.join(_least_of_class(rows, radius), "print").select(*names, "print", F.col("least.id").alias("component_id"))


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stand for their group, with all their columns.

    Texts move once, to meet the identities to keep; rows that agree in one then lie together.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, identity(key, text), text=text).withColumnRenamed("carried_0", "identity").checkpoint()

    def parts(identity: str) -> list[Column]:
        return [F.coalesce(F.col(f"{identity}.id").cast("string"), F.lit("")).alias("i"), F.col(f"{identity}.no_id").alias("n"), F.col(f"{identity}.digest").alias("d")]

    kept = _least_of_class(rows, radius).select(*parts("least")).distinct()
    told = docs.select(packed(docs), identity(key, text).alias("identity")).select("row", *parts("identity"))
    place = F.row_number().over(W.partitionBy("i", "n", "d").orderBy(F.lit(0)))
    return told.join(kept, ["i", "n", "d"]).withColumn("place", place).where("place = 1").select("row.*")
