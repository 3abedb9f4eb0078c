"""Connected components of a graph of links by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.session import keep


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Links (v, least): neighbours of a node moved to the least node among it and them.

    Small stars take the smaller neighbours of a node and the node itself, large stars its larger neighbours. The minimum is
    aggregated before it moves, so a node with very many neighbours costs one row per task; the join that brings
    it back can be split.
    """
    if small:
        around = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        around = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
    least = around.groupBy("node").agg(F.min("other").alias("lowest")).select("node", F.least("node", "lowest").alias("least"))
    joined = around.join(least, "node")
    if small:
        moved = joined.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        moved = joined.filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b): the smallest node it can reach.

    Every round is written to the shared folder. It ends when a round changes nothing; the number of rounds grows with
    the logarithm of the longest path.
    """
    now = keep(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        now = keep(_stars(_stars(now, small=False), small=True), "links")
        # the sum of row hashes tells whether the links changed
        total = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == total:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = total
