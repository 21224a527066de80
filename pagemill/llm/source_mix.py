"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected `target / source_size` times in the mix. The expected copies are
added up in a fixed order within the source, one offset is added per source, and a document is emitted once for
each whole number that its stretch of the sum crosses. The order runs through the sizes, so a source's taken
words differ from its target by little more than its largest document.

No task sees a whole source: the sum is taken over (size band, bucket) cells, whose counts are summed before
anything is ordered; only within a cell are the documents themselves put in order, and equal rows have one order. The targets are
worked out over one row a source, in one task: sources are named collections, not hosts.

Defined results: a null text has size 0; a null source is a source of its own and comes last; repeated rows
and repeated ids are documents of their own; sources without any word take nothing; an empty table gives an
empty table. The offset is derived from the source's name and `seed`, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import packed, word_count
from pagemill.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 1024
MIXER = 2654435761


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with a row per source.

    The targets are min(most * size, level * weight) for the one level at which they add up to all sizes: that is
    where sharing the excess anew by weight comes to rest. Sorted by size per weight, the sources that stop at
    their cap are a prefix; the level follows from running sums and is the largest one whose own source does not stop.
    """
    order = W.orderBy("source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.select("source", F.col("source_size").cast("double").alias("size"), weight.alias("weight"))
    by_need = W.orderBy(F.col("size") / F.col("weight"), "source")
    upto = by_need.rowsBetween(W.unboundedPreceding, -1)
    onward = by_need.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("size").over(everything) - most * F.coalesce(F.sum("size").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    capped = ranked.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > most * F.col("size"))
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.least(most * F.col("size"), F.coalesce(final * F.col("weight"), most * F.col("size")))
    return capped.select("source", F.col("size").cast("long").alias("source_size"), target.alias("target"))


def _source_key(source: Column) -> Column:
    """A name for every source, null included, that sorts by code point with the null source last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _offset(source: Column, seed: int) -> Column:
    """Uniform in [0, 1), from the first 48 bits of a digest of the source's name."""
    digits = F.substring(F.sha2(F.concat(source, F.lit(f"#{seed}")), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**48))


def mix(docs: DataFrame, *carried: Column, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """`carried` columns, then size, source_size, target, copies and taken of every row of `docs`."""
    kept_names = [f"carried_{i}" for i in range(len(carried))]
    rows = docs.select(
        *[c.alias(n) for c, n in zip(carried, kept_names, strict=True)],
        _source_key(F.col(source)).alias("source"),
        F.col(key).alias("key"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 8), 16, 10).cast("long").alias("told"),
        word_count(F.col(text)).alias("size"),
    )
    # Bits of id and text: rows without an id, or that share one, spread over the cells and have an order like any other.
    bits = F.coalesce(F.col("key").cast("long"), F.lit(-1)).bitwiseXOR(F.col("told")).bitwiseAND(F.lit(2**31 - 1))
    mixed = F.pmod(bits * F.lit(MIXER), F.lit(2**32))
    rows = rows.select("*", mixed.alias("mixed"), F.length(F.bin("size")).alias("octave"))
    band = F.col("octave") * 8 + F.floor(F.col("size") * 8 / F.pow(F.lit(2.0), F.col("octave").cast("double")))
    bucket = F.floor(F.col("mixed") / F.lit(2**32 // BUCKETS))
    rows = rows.select(*kept_names, "source", "key", "size", "mixed", band.cast("long").alias("band"), bucket.cast("long").alias("bucket"))

    # Counted once: without the cut every branch below would read the texts again.
    ensure_checkpoint_dir(docs.sparkSession)
    cells = rows.groupBy("source", "band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).checkpoint()
    bands = cells.groupBy("source", "band").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    totals = bands.groupBy("source").agg(F.sum("words").alias("source_size"))
    earlier_bands = W.partitionBy("source").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    earlier_cells = W.partitionBy("source", "band").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    band_start = bands.select("source", "band", F.coalesce(F.sum("n").over(earlier_bands), F.lit(0)).alias("band_start"))
    cell_start = cells.select("source", "band", "bucket", F.coalesce(F.sum("n").over(earlier_cells), F.lit(0)).alias("cell_start"))
    starts = cell_start.join(band_start, ["source", "band"]).join(source_targets(totals, weights, most), "source")

    place = F.row_number().over(W.partitionBy("source", "band", "bucket").orderBy("size", "mixed", "key"))
    joined = rows.withColumn("place", place).join(starts, ["source", "band", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("band_start") + F.col("cell_start") + F.col("place")
    offset = _offset(F.col("source"), seed)
    crossed = F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)
    copies = F.greatest(F.lit(0), F.least(crossed, F.lit(most))).cast("long")
    return joined.select(*kept_names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with all its columns."""
    drawn = mix(docs, packed(docs), **options).where("copies > 0")
    return drawn.select("carried_0", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("carried_0.*")
