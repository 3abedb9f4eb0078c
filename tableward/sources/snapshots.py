"""Full snapshots stored with a tree of checksums, so that two of them are compared by reading only what differs.

A row belongs to a bucket by the hash of its key. A bucket's checksum is its number of rows with the sum and the exclusive or of their 64-bit row hashes; these
merge, so a node of the tree adds up its ``2 ** STEP`` children. Comparing goes down from the root through nodes that differ; rows are read and joined only for
buckets that do. Buckets whose three values agree are taken as equal. That is wrong only if different rows agree in count, sum and exclusive or of their hashes.

``path/rows/part=p`` holds the rows by the first level below the root, sorted by bucket, so folders and row groups are skipped; ``path/tree`` holds
(level, node, n, total, mix). The tree is written last: a snapshot without it was not finished.

Keys are unique in a snapshot. Rows with a missing key column match nothing in a bucket that differs, as in ``changes.snapshot_diff``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.operators import changes
from tableward.session import keep

STEP = 6
#: Buckets are 2 ** (STEP * LEVELS): 4,096 at two levels, 262,144 at three.
LEVELS = 2
_TREE = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.DecimalType(38, 0)),
        T.StructField("mix", T.LongType()),
    ]
)


def _row_hash(columns: list[str]) -> Column:
    """Hash of values and of which of them are missing, since a missing one alone leaves a hash as it is."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def write_snapshot(df: DataFrame, path: str, key: list[str], levels: int = LEVELS) -> None:
    """Store a snapshot at ``path``, a new folder, and its tree. Snapshots are comparable if key, columns and levels agree."""
    spark, columns = df.sparkSession, sorted(df.columns)
    if {"bucket", "part"} & set(columns):
        raise ValueError("columns named bucket or part would clash with the snapshot's own")
    bucket = F.pmod(F.xxhash64(*sorted(key)), F.lit(1 << STEP * levels))
    placed = df.withColumn("bucket", bucket).withColumn("part", F.shiftright("bucket", STEP * (levels - 1)))
    spread = placed.repartitionByRange("bucket", _row_hash(columns)).sortWithinPartitions("part", "bucket")
    spread.write.partitionBy("part").parquet(f"{path}/rows")
    kind = T.StructType([*df.schema.fields, T.StructField("bucket", T.LongType())])
    hashed = spark.read.schema(kind).parquet(f"{path}/rows").select("bucket", _row_hash(columns).alias("h"))
    leaves = hashed.groupBy(F.col("bucket").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("h").alias("mix")
    )
    leaves = keep(leaves, "leaves")
    whole = leaves.select(F.lit(levels).alias("level"), *leaves.columns)
    for level in range(levels):
        up = leaves.groupBy(F.shiftright("node", STEP * (levels - level)).alias("node"))
        sums = up.agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mix").alias("mix"))
        whole = whole.unionByName(sums.withColumn("level", F.lit(level)))
    whole.repartition(1).sortWithinPartitions("level", "node").write.parquet(f"{path}/tree")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None, levels: int = LEVELS) -> DataFrame:
    """Rows of a snapshot, or only those of some buckets."""
    kind = T.StructType([*schema.fields, T.StructField("bucket", T.LongType()), T.StructField("part", T.LongType())])
    rows = spark.read.schema(kind).parquet(f"{path}/rows")
    if buckets is not None:
        parts = sorted({b >> STEP * (levels - 1) for b in buckets})
        rows = rows.filter(F.col("part").isin(parts) & F.col("bucket").isin(buckets))
    return rows.select(*schema.names)


def differing(spark: SparkSession, old: str, new: str, levels: int = LEVELS) -> list[int]:
    """Buckets whose checksums differ, found from the root down; at most all buckets of the tree."""
    nodes: list[int] = [0]
    for level in range(levels + 1):
        sides = []
        for path in (old, new):
            side = spark.read.schema(_TREE).parquet(f"{path}/tree").filter(F.col("level") == level)
            sides.append(side.filter(F.shiftright("node", STEP).isin(nodes)) if level else side)
        a, b = (s.select("node", F.struct("n", "total", "mix").alias(name)) for s, name in zip(sides, ("a", "b")))
        changed = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        nodes = sorted(r.node for r in changed.select("node").collect())
        if not nodes:
            return []
    return nodes


def _pair(spark, old, new, schema, levels):
    buckets = differing(spark, old, new, levels)
    return buckets, *(read_snapshot(spark, p, schema, buckets, levels) for p in (old, new))


def stored_diff(spark: SparkSession, old: str, new: str, schema: T.StructType, key: list[str], columns: list[str], levels: int = LEVELS) -> DataFrame:
    """``changes.snapshot_diff`` of two stored snapshots."""
    _, a, b = _pair(spark, old, new, schema, levels)
    return changes.snapshot_diff(a, b, key, columns)


def stored_reconcile(spark: SparkSession, old: str, new: str, schema: T.StructType, key: list[str], levels: int = LEVELS) -> DataFrame:
    """``changes.full_reconcile`` of two stored snapshots; rows of equal buckets are counted from the tree."""
    buckets, a, b = _pair(spark, old, new, schema, levels)
    leaves = spark.read.schema(_TREE).parquet(f"{old}/tree").filter(F.col("level") == levels)
    same = leaves.filter(~F.col("node").isin(buckets)).agg(F.sum("n").alias("n")).filter("n > 0").select(F.lit("same").alias("side"), "n")
    return changes.full_reconcile(a, b, key).unionByName(same).groupBy("side").agg(F.sum("n").alias("n"))
