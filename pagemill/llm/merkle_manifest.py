"""Merkle manifest of a dataset, by butterfly exchange.

Rows are leaves of their tree (a source), in the order of a key; a tree's root is a leaf of the tree of all sources. Every
`FANOUT` neighbours become one node, level by level. A leaf's proof is what stands left and right of its path on each level.

Leaves are dealt to aligned blocks of `FANOUT ** LEVELS`, and each block hashes its own subtree. Then the blocks of a tree swap
subtree roots round by round: in round r a block meets those whose numbers differ from its own in the r-th digit alone, so
aligned groups of blocks join to groups of three times the size, each block hashes the ancestor for itself and keeps what stood beside its own part.
When the rounds are over every block has its proof up to the root; nothing is sent down. The last group of a tree may be smaller than its
partners: its blocks then answer for the places that it lacks. No task sees more than a block or `FANOUT` roots, however large a source is.

Defined results: a null in a leaf's column is `-` and differs from an empty value; the null source comes first, null keys first within
their source; rows of one key stand in the order of their leaves, and equal rows share out their places among them; a tree of one leaf has that leaf as its root
and no proof; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from pagemill.llm.common import stored

FANOUT = 3
LEVELS = 7


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after another: each `-` if null, else its bytes in UTF-8, their number and a colon before them."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def _joined(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def local_levels(leaves: list[str], alone: bool, height: int = LEVELS) -> list[list[str]]:
    """The nodes of a block, level by level from its leaves to its root. A block that is its tree ends at the first single node;
    one of several goes up all its levels, as its neighbours do."""
    levels = [leaves]
    for _ in range(height):
        if alone and len(levels[-1]) == 1:
            break
        below = levels[-1]
        levels.append([_joined(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _beside(level: list[str], i: int) -> tuple[str, str]:
    """The digests of a node's run that stand left and right of it."""
    run = i - i % FANOUT
    return "".join(level[run:i]), "".join(level[i + 1 : run + FANOUT])


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` (tree, ...) with `place` from 0 within the tree and `leaves`, the tree's number of rows.

    Rows are sorted by range once and written with their numbers, so a tree of any size is spread over tasks and places hold when
    executors are lost; starts come from counts per tree and range.
    """
    numbers = F.monotonically_increasing_id()
    spread = rows.withColumn("spread", F.xxhash64(numbers))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "spread")]
    held = stored(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread").withColumn("at", numbers))
    held = held.withColumn("part", F.shiftright("at", 33))
    runs = held.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select("tree", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy("tree")).alias("leaves"))
    return held.join(starts, ["tree", "part"]).withColumn("place", F.col("start") + F.col("at") - F.col("first")).drop("part", "at", "first", "start")


@dataclass
class Forest:
    """flat (tree, block, place, alone, leaf, row): all leaves. upper (tree, block, root, lefts, rights): the root of every block's tree and the
    proof from the block's root up to it, as what stands left and right of the path on each level."""

    flat: DataFrame
    upper: DataFrame
    height: int = LEVELS


def forest(rows: DataFrame, *order: str, height: int = LEVELS) -> Forest:
    """The trees of `rows` (tree, leaf, row and the columns of `order`), in blocks of `height` levels."""
    width = FANOUT**height
    held = placed(rows, *order).select("tree", F.floor(F.col("place") / width).alias("block"), "place", "leaves", "leaf", "row")
    flat = held.withColumn("alone", F.col("leaves") <= width)

    def subtree(group):
        import pyarrow as pa

        group = group.sort_by("place")
        root = local_levels(group.column("leaf").to_pylist(), group.column("alone")[0].as_py(), height)[-1][0]
        one = group.slice(0, 1)
        return pa.table({"tree": one.column("tree"), "place": one.column("block"), "leaves": one.column("leaves"), "node": pa.array([root])})

    sent = flat.select("tree", "block", "place", "leaves", "alone", "leaf")
    roots = sent.groupBy("tree", "block").applyInArrow(subtree, "tree string, place long, leaves long, node string")
    told = butterfly(roots.select("tree", "place", F.ceil(F.col("leaves") / width).alias("n"), "node"))
    return Forest(flat.drop("leaves"), told.select("tree", F.col("place").alias("block"), F.col("node").alias("root"), "lefts", "rights"), height)


def butterfly(nodes: DataFrame) -> DataFrame:
    """(tree, place, node, lefts, rights) of `nodes` (tree, place, n, node), n of them a tree: the root, and what stands beside the path to it.

    After round r a node is the root of its aligned group of FANOUT ** r places. Each round is one small exchange, and is written, so a
    lost executor costs a round.
    """
    none = F.array().cast("array<string>")
    state = stored(nodes.select("tree", "place", "n", "node", none.alias("lefts"), none.alias("rights")))
    most, stride = state.agg(F.max("n")).first()[0] or 0, 1
    while stride < most:
        number = F.floor(F.col("place") / stride)
        low, digit, last = F.col("place") % stride, number % FANOUT, F.floor((F.col("n") - 1) / stride)
        short = F.col("n") - last * stride
        answers = (number == last) & (short < stride) & (digit > 0)
        # A short last group speaks for the places that it lacks, too.
        to = F.when(answers, F.sequence(low, F.lit(stride - 1).cast("long"), F.when(answers, short).otherwise(F.lit(1)))).otherwise(F.array(low))
        sent = state.select("tree", F.floor(number / FANOUT).alias("group"), F.explode(to).alias("to"), low.alias("low"), digit.alias("digit"), "place", "n", "node", "lefts", "rights")
        own = F.col("to") == F.col("low")
        told = F.struct("digit", "node", own.alias("own"), "place", "n", *[F.when(own, F.col(c)).alias(c) for c in ("lefts", "rights")])
        met = sent.groupBy("tree", "group", "to").agg(F.array_sort(F.collect_list(told)).alias("met"))

        def joined(member: Column, beside) -> Column:
            return F.concat_ws("", F.transform(F.filter("met", lambda m: beside(m, member)), lambda m: m["node"]))

        def moved(m: Column) -> Column:
            up = m["n"] > stride
            return F.struct(
                m["place"].alias("place"), m["n"].alias("n"), F.when(up, F.sha2(joined(m, lambda x, y: F.lit(True)), 256)).otherwise(m["node"]).alias("node"),
                F.when(up, F.concat(m["lefts"], F.array(joined(m, lambda x, y: x["digit"] < y["digit"])))).otherwise(m["lefts"]).alias("lefts"),
                F.when(up, F.concat(m["rights"], F.array(joined(m, lambda x, y: x["digit"] > y["digit"])))).otherwise(m["rights"]).alias("rights"),
            )

        state = stored(met.select("tree", F.inline(F.transform(F.filter("met", lambda m: m["own"]), moved))))
        stride *= FANOUT
    return state.drop("n")


def opened(trees: Forest) -> DataFrame:
    """(tree, row, leaf, place, root, lefts, rights) of every leaf: its proof within the block, and then the block's."""
    extra = [f for f in trees.upper.schema.fields if f.name not in ("tree", "block", "lefts", "rights")]
    fields = {f.name: f for f in trees.flat.schema.fields}
    lists, height = ArrayType(StringType()), trees.height
    schema = StructType([*[fields[c] for c in ("tree", "row", "leaf", "place")], *extra, StructField("lefts", lists), StructField("rights", lists)])

    def run(block, upper):
        import pyarrow as pa

        block = block.sort_by("place")
        levels = local_levels(block.column("leaf").to_pylist(), block.column("alone")[0].as_py(), height)
        above = [upper.column(c)[0].as_py() for c in ("lefts", "rights")]
        sides: tuple[list, list] = ([], [])
        for i in range(block.num_rows):
            beside = [_beside(level, i // FANOUT**k) for k, level in enumerate(levels[:-1])]
            for side, (own, upward) in enumerate(zip(zip(*beside, strict=True) if beside else ((), ()), above, strict=True)):
                sides[side].append([*own, *upward])
        columns = {c: block.column(c) for c in ("tree", "row", "leaf", "place")}
        columns |= {f.name: pa.chunked_array([pa.array([upper.column(f.name)[0].as_py()] * block.num_rows, upper.column(f.name).type)]) for f in extra}
        return pa.table({**columns, "lefts": pa.array(sides[0], pa.list_(pa.string())), "rights": pa.array(sides[1], pa.list_(pa.string()))})

    return trees.flat.groupBy("tree", "block").cogroup(trees.upper.groupBy("tree", "block")).applyInArrow(run, schema)


def manifest(docs: DataFrame, leaf: Column, *carried: Column, source: str = "source", key: str = "doc_id", height: int = LEVELS) -> DataFrame:
    """`carried` columns, then leaf, place (from 0 in its source), subroot, root, lefts and rights of every row of `docs`."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    row = F.struct(*[c.alias(f"carried_{i}") for i, c in enumerate(carried)]) if carried else F.struct(F.lit(None).cast("int").alias("none"))
    leaves = stored(docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("leaf"), row.alias("row")))
    sources = forest(leaves, "key", "leaf", height=height)
    first = sources.upper.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"), F.struct(F.col("tree").alias("source")).alias("row"))
    top = opened(forest(first, "name", height=height)).select(F.col("row.source").alias("tree"), F.col("root").alias("above"), F.col("lefts").alias("more_lefts"), F.col("rights").alias("more_rights"))
    upper = sources.upper.join(top, "tree").select("tree", "block", F.col("root").alias("subroot"), F.col("above").alias("root"), F.concat("lefts", "more_lefts").alias("lefts"), F.concat("rights", "more_rights").alias("rights"))
    told = opened(Forest(sources.flat, stored(upper), height))
    return told.select(*[F.col(f"row.carried_{i}").alias(f"carried_{i}") for i in range(len(carried))], "leaf", "place", "subroot", "root", "lefts", "rights")


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of all digests of a proof, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.zip_with(lefts, rights, lambda a, b: F.concat(a, b))), 256)


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda node, beside: F.sha2(F.concat(beside["l"], node, beside["r"]), 256))
