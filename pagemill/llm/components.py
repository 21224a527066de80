"""Connected components of a table of links, by alternating star contractions.

Each round every node hands its larger neighbours to its smallest one, then its smaller neighbours likewise, until all
links point at the least node of their component. Only minima per node are aggregated, so no node's neighbours are ever
gathered in one place; a round ends in a checkpoint, which also survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir


def least_members(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: bigint) that is not itself the least of its component.

    Links may repeat, run either way and join a node to itself; no links give no rows.
    """
    ensure_checkpoint_dir(links.sparkSession)
    down = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return down.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
