"""Near copies by SimHash and BK-trees beyond a few bits: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more.

Fingerprints of such texts differ in some ten bits, too many for shards of common bit blocks. Shards are keyed instead by
bands of least shingle hashes: two texts of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS, 0.9998 at 4/5.
In a shard the fingerprints form a BK-tree, searched with a radius that all but one in ten thousand pairs at 4/5 keep to, and
what the trees find is compared by whole shingle sets. So no link is ever wrong, and one in some three thousand pairs at
4/5 (fewer above) has no link of its own; such a text is still found where a third one links the two.

Texts of equal words are one node. On its way into a shard's tree every node meets others, and is first compared with the
nearest of these alone, and with the shard's hub, the node that shares the most keys with the most nodes: of a text and its
edited copies that is the text. Components of what that links are contracted, nodes still apart are once more compared with
the nearest they meet of another component, and what remains is searched for with the full radius, where sketches turn away
most pairs that are not alike: the parities of hashed cells, which differ in no more places than the sets do, and counts
of equal least hashes. Shards above `SHARD` nodes are dealt into parts: nodes of the shard's largest component into parts of
their own, which never meet each other, so a group of near copies costs what its size is and not its square.

Defined results: a null text counts as empty; texts without words are copies of each other; a text of fewer than five words is
one shingle. Of a component the row with the least id is kept, nulls last, and one of rows that agree in id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import packed, stored
from pagemill.llm.components import least_members
from pagemill.llm.simhash_bk import BATCH_POINTS, SHARD, forest, identity, majority, shingle_hashes, within
from pagemill.session import ensure_checkpoint_dir

SHINGLE = 5
#: The least similarity, as a fraction.
ALIKE = (4, 5)
RADIUS = 20
BANDS, ROWS = 16, 4
#: Characters of text worked on at a time.
SLICE = 400_000
CELLS = 1 << 24
#: Equal least hashes, of BANDS * ROWS, below which a pair is turned away unread: four standard deviations under 4/5.
FEW_EQUAL = 38
#: Cells of parities, and longs of a sketch: low bytes of least hashes, parities, the size of the set.
PARITIES = 512
SKETCH = BANDS * ROWS // 8 + PARITIES // 64 + 1
#: Odd multipliers that give each least hash an order of its own, and the one that folds a band into its key.
_MIX = (np.random.default_rng(20240).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def words_digest(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join((text or "").encode("utf-8", "replace").lower().split()))


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of BANDS keys, and a sketch of SKETCH longs, for each of the sets, none of which is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.empty((len(sets), BANDS), np.uint64)
    sketch = np.empty((len(sets), BANDS * ROWS), np.uint8)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(flat * _MIX[i], starts)
            sketch[:, i] = least & np.uint64(255)
            key = (key ^ least ^ (least >> np.uint64(31))) * _FOLD
        keys[:, band] = key
    cells = (flat >> np.uint64(32)).astype(np.int64) % PARITIES + np.repeat(np.arange(len(sets)) * PARITIES, [len(s) for s in sets])
    odd = np.packbits((np.bincount(cells, minlength=len(sets) * PARITIES) & 1).astype(np.uint8).reshape(len(sets), PARITIES), axis=1)
    sizes = np.array([[len(s)] for s in sets], np.int64)
    return keys.view(np.int64), np.concatenate([sketch.view(np.int64), odd.view(np.int64), sizes], axis=1)


def sketches_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of two rows of sketches may be alike."""
    least = BANDS * ROWS // 8
    equal = (np.ascontiguousarray(a[:, :least]).view(np.uint8) == np.ascontiguousarray(b[:, :least]).view(np.uint8)).sum(axis=1)
    apart = np.bitwise_count((a[:, least:-1] ^ b[:, least:-1]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    sizes = a[:, -1] + b[:, -1]
    return (equal >= FEW_EQUAL) & (apart * sum(ALIKE) <= sizes * (ALIKE[1] - ALIKE[0]))


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Slices of bounded text, or of one text where that is longer."""
    upto = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // SLICE
    cuts = [*np.flatnonzero(np.diff(upto, prepend=-1)).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield slice(a, b)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(identity, node, print, keys) of every row: the digest of its words, the fingerprint and the band keys of its shingle set."""
    parts = ("no_id", "id", "digest")
    named = docs.select(identity(key, text).alias("identity"), F.col(text).alias("text")).select(*[F.col(f"identity.{p}").alias(p) for p in parts], "text")
    schema = ", ".join(f"{p} {named.schema[p].dataType.simpleString()}" for p in parts) + ", node long, print long, keys array<long>, sketch array<long>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame["text"]):
                out = frame.iloc[part]
                sets = [shingle_set(t) for t in out["text"]]
                full = [s for s in sets if len(s)]
                keys, sketches = map(iter, band_keys(full)) if full else (iter(()), iter(()))
                none = np.zeros(0, np.int64)
                nodes, prints = ([f(x) for x in xs] for f, xs in ((words_digest, out["text"]), (majority, sets)))
                out = out.drop(columns="text")
                out["node"], out["print"] = np.array(nodes, np.uint64).view(np.int64), np.array(prints, np.uint64).view(np.int64)
                out["keys"], out["sketch"] = (pd.Series([next(x) if len(s) else none for s in sets], index=out.index, dtype=object) for x in (keys, sketches))
                yield out

    return named.mapInPandas(run, schema).select(F.struct(*parts).alias("identity"), "node", "print", "keys", "sketch")


def _shards(nodes: DataFrame, shard: int) -> DataFrame:
    """(key, node, print, n, parts) of every node under each key that it shares with another."""
    members = nodes.select("node", "print", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(sizes, "key").select("key", "node", "print", "n", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("parts"))


def _pairs(frames: Iterator[pd.DataFrame], find) -> Iterator[pd.DataFrame]:
    """The pairs that `find` gives for rows of arrays, some rows of bounded size at a time."""
    held, size = [], 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            held.append(row)
            size += len(row.nodes) + (0 if getattr(row, "others", None) is None else len(row.others))
            if size > BATCH_POINTS:
                yield find(held)
                held, size = [], 0
    if held:
        yield find(held)


def _as_pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _flat(rows: list, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.asarray(getattr(r, name), np.int64) for r in rows if getattr(r, name) is not None]])


def nearest_pairs(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of each node of `shards` (key, node, print, parts, root) with the nearest of another root that its shard's BK-tree
    leads it past."""
    dealt = shards.withColumn("part", F.expr("pmod(xxhash64(node), parts)").cast("int"))
    groups = dealt.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("node", "print", "root"))).alias("rows"))
    trees = groups.select(*[F.col(f"rows.{c}").alias(f"{c}s") for c in ("node", "print", "root")])

    def find(rows: list) -> pd.DataFrame:
        nodes, prints, roots = _flat(rows, "nodes"), _flat(rows, "prints").view(np.uint64), _flat(rows, "roots")
        met: list[np.ndarray] = []
        forest(prints, np.repeat(np.arange(len(rows)), [len(r.nodes) for r in rows]), met, roots)
        near = np.flatnonzero(met[1] <= radius)
        return _as_pairs(nodes[near], nodes[met[0][near]])

    return trees.mapInPandas(lambda frames: _pairs(frames, find), "a long, b long")


def hub_pairs(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of each node with its shard's hub."""
    known = shards.groupBy("node").agg(F.sum("n").alias("shared"))
    hubs = shards.join(known, "node").groupBy("key").agg(F.max_by(F.struct("node", "print"), F.struct("shared", "node")).alias("hub"))
    met = shards.join(hubs, "key").where((F.col("node") != F.col("hub.node")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("hub.print"))) <= radius))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def first_pairs(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """What is compared before anything is known."""
    return nearest_pairs(shards.withColumn("root", F.col("node")), radius).unionByName(hub_pairs(shards, radius)).distinct()


def _open(shards: DataFrame, roots: DataFrame) -> DataFrame:
    """The shards (with roots) whose nodes lie in different components of `roots` (node, root)."""
    told = shards.join(roots, "node", "left").select("key", "node", "print", "parts", F.coalesce("root", "node").alias("root"))
    apart = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return told.join(apart, "key")


def rest_pairs(open_: DataFrame, nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Pairs (a, b) of nodes of one of the `open_` shards within the radius and in different components, unless their sketches say
    that they are far from alike."""
    told = open_
    sizes = told.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), (F.sum("n") - F.max("n")).alias("strays")).where("roots > 1")
    spread = told.join(mixed.select("key", "main", "strays"), "key").join(nodes.select("node", "sketch"), "node")
    # Parts below zero hold the main component alone; small shards stay whole.
    many = F.ceil(F.col("strays") / F.lit(shard)).cast("int")
    part = F.when(F.col("parts") == 1, 0).when(F.col("root") == F.col("main"), -1 - F.expr("pmod(xxhash64(node), parts)")).otherwise(F.pmod(F.xxhash64("node"), many)).cast("int")
    fields = ("nodes", "prints", "roots", "sketches")
    lists = [*[F.col(f"rows.{c}").alias(f"{c}s") for c in ("node", "print", "root")], F.flatten("rows.sketch").alias("sketches")]
    groups = spread.withColumn("part", part).groupBy("key", "part").agg(F.collect_list(F.struct("node", "print", "root", "sketch")).alias("rows")).select("key", "part", *lists)
    renamed = {"part": "to", "nodes": "others", **{f: f"other_{f}" for f in fields[1:]}}
    none = [F.lit(None).cast("array<long>").alias(renamed[f]) for f in fields]
    inside = groups.where("part >= 0").select(*fields, *none)
    across = groups.where("part >= 0").join(groups.withColumnsRenamed(renamed), "key").where("to < part").select(*inside.columns)

    def find(rows: list) -> pd.DataFrame:
        nodes, prints, roots_ = _flat(rows, "nodes"), _flat(rows, "prints").view(np.uint64), _flat(rows, "roots")
        sizes = [len(r.nodes) for r in rows]
        starts, keys, children = forest(prints, np.repeat(np.arange(len(rows)), sizes))
        asked = [[getattr(r, f if r.others is None else renamed[f]) for r in rows] for f in fields]
        o_nodes, o_prints, o_roots, o_sketch = (np.concatenate([np.asarray(x, np.int64) for x in xs]) for xs in asked)
        counts = [len(x) for x in asked[0]]
        sketch, o_sketch = (x.reshape(-1, SKETCH) for x in (_flat(rows, "sketches"), o_sketch))
        found = [np.zeros((2, 0), np.int64)]
        for q, p in within(o_prints.view(np.uint64), np.repeat(starts, counts), prints, keys, children, radius):
            apart = o_roots[q] != roots_[p]
            q, p = q[apart], p[apart]
            for at in range(0, len(q), 100_000):
                some, other = q[at : at + 100_000], p[at : at + 100_000]
                near = sketches_allow(o_sketch[some], sketch[other])
                found.append(np.stack([o_nodes[some[near]], nodes[other[near]]]))
        return _as_pairs(*np.concatenate(found, axis=1))

    return inside.unionByName(across).mapInPandas(lambda frames: _pairs(frames, find), "a long, b long").distinct()


def _bits(asked: DataFrame) -> np.ndarray:
    """A bit for each of CELLS cells, set where a place of `asked` falls: texts are read by it where they lie and never shuffled."""
    cell = F.expr(f"pmod(place, {CELLS}) + 1")
    found = asked.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    bits = np.zeros((CELLS // 32_768, 4096), np.uint8)
    for row in found:
        bits[row["bucket"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Those of `pairs` (a, b), each once, whose whole shingle sets are alike. Only the rows that stand for a node asked for are read closely."""
    asked = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    bits = _bits(asked.select(F.xxhash64("identity").alias("place")))
    told = docs.select(F.xxhash64(identity(key, text)).alias("place"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = frame["place"].to_numpy() % CELLS
            texts = frame["text"][(bits[cell >> 3] >> (cell & 7) & 1).astype(bool)].drop_duplicates()
            for part in _slices(texts) if len(texts) else ():
                some = texts.iloc[part]
                yield pd.DataFrame({"node": np.array([words_digest(t) for t in some], np.uint64).view(np.int64), "found": [shingle_set(t).view(np.int64) for t in some]})

    sets = told.mapInPandas(run, "node long, found array<long>").join(asked.select("node"), "node", "left_semi")
    sets = stored(sets.groupBy("node").agg(F.first("found").alias("found")))
    both = pairs.join(sets.toDF("a", "a_found"), "a").join(sets.toDF("b", "b_found"), "b")
    shared = F.size(F.array_intersect("a_found", "b_found")).cast("long")
    return both.where(shared * sum(ALIKE) >= (F.size("a_found") + F.size("b_found")) * ALIKE[0]).select("a", "b")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): nodes (node, identity of the least row with its words, print), and the component (node, root) of every node that is not its root."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = signatures(docs, key, text)
    nodes = stored(rows.groupBy("node").agg(F.min("identity").alias("identity"), *[F.first(c).alias(c) for c in ("print", "keys", "sketch")]))
    shards = stored(_shards(nodes, shard))
    tried = stored(first_pairs(shards, radius))
    found = stored(alike(tried, nodes, docs, key, text))
    again = stored(nearest_pairs(_open(shards, least_members(found)), radius).distinct().join(tried, ["a", "b"], "left_anti"))
    found = found.unionByName(stored(alike(again, nodes, docs, key, text)))
    open_ = stored(_open(shards, least_members(found)))
    rest = stored(rest_pairs(open_, nodes, radius, shard).join(tried.unionByName(again), ["a", "b"], "left_anti"))
    return nodes.drop("keys", "sketch"), least_members(found.unionByName(alike(rest, nodes, docs, key, text)))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of `docs` that stand for their group of near copies, with all their columns. Rows move once, to meet those to keep."""
    nodes, roots = components(docs, key, text, radius, shard)
    told = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("identity").alias("identity"))

    def parts(name: str) -> list[Column]:
        return [F.coalesce(F.col(f"{name}.id").cast("string"), F.lit("")).alias("i"), F.col(f"{name}.no_id").alias("n"), F.col(f"{name}.digest").alias("d")]

    rows = docs.select(packed(docs), identity(key, text).alias("identity")).select("row", *parts("identity"))
    place = F.row_number().over(W.partitionBy("i", "n", "d").orderBy(F.lit(0)))
    return rows.join(told.select(*parts("identity")), ["i", "n", "d"]).withColumn("place", place).where("place = 1").select("row.*")
