"""Order-dependent helpers that stay spread out when one key is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableward.session import keep

def with_neighbour(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], out: str, forward: bool = False
) -> DataFrame:
    """lag (or lead, ``forward``) of ``values`` as struct ``out``, per key in ``order``.

    Rows are range-partitioned by key and order and written down, so a key with very many rows lies in several neighbouring
    partitions, also if they share one time; ``order`` must end in a column that tells them apart. The window runs per partition and key. At
    the edge of a partition the row takes the border row of the nearest partition with its key: only keys in several
    partitions have any, so the borders are at most two rows per partition.
    """
    packed = F.struct(*values)
    step, border = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    placed = keep(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "neighbours")
    near = placed.withColumn("_near", step(packed).over(Window.partitionBy("_part", *keys).orderBy(*order)))
    spread = placed.groupBy(*keys).agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi")).filter("_lo < _hi").select(*keys)
    edges = (
        placed.join(F.broadcast(spread), keys, "left_semi")
        .groupBy("_part", *keys)
        .agg(border(packed, F.struct(*order)).alias("_edge"))
        .withColumn("_carry", step("_edge").over(Window.partitionBy(*keys).orderBy("_part")))
        .select("_part", *keys, "_carry")
    )
    return (
        near.join(F.broadcast(edges), ["_part", *keys], "left")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_part")
    )


def with_position(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Global row number without a one-task window.

    A range sort spreads the rows, the numbered rows are written down so that their
    numbering cannot change on a retry, and each partition's numbers are shifted by the rows before it.
    ``order`` must end in a unique column. The offset table has one row per partition.
    """
    tag = F.monotonically_increasing_id()
    placed = keep(
        df.orderBy(*order)
        .withColumn("_at", tag)
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at") - F.shiftleft(F.col("_part"), 33)),
        "placed",
    )
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
        .select("_part", "_before")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_at") + 1)
        .drop("_part", "_at", "_before")
    )


def with_rank_by_count(df: DataFrame, count_col: str, out: str = "rank") -> DataFrame:
    """SQL ``rank()`` by a whole-number count, highest first.

    Ranks are computed on the distinct counts. Counts that add up to N events have at most
    sqrt(2N) distinct values (1.4 million for 10^12 events), so that window and the broadcast of its result
    stay small at any scale, and tables that share a common count are not gathered in one task.
    """
    levels = (
        df.groupBy(count_col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(Window.orderBy(F.desc(count_col))))
        .select(count_col, (F.col("_upto") - F.col("_n") + 1).alias(out))
    )
    return df.join(F.broadcast(levels), count_col)
