"""Table layout and upkeep: file sizes, partitioning, statistics, vacuum."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import as_date

MB = 1024 * 1024
GB = 1024 * MB
TB = 1024 * GB


def small_files(detail: DataFrame, below_mb: int = model.SMALL_FILE_MB) -> DataFrame:
    avg = F.try_divide(F.col("size_bytes").cast("double"), F.col("num_files").cast("double")) / MB
    return detail.withColumn("avg_mb", F.round(avg, 2)).filter(avg < below_mb).select("table_id", "avg_mb")


def over_partitioned(detail: DataFrame) -> DataFrame:
    """Partitioned tables that are under 1 TB or under 1 GB per partition."""
    per = F.try_divide(F.col("size_bytes").cast("double"), F.col("num_partitions").cast("double")) / MB
    dated = F.col("partition_column").rlike("(date|day|hour|time|_ts)")
    reason = (
        F.when(F.col("size_bytes") < TB, F.when(dated, "small table by date").otherwise("small table"))
        .when(per < 1024, F.when(dated, "thin date partitions").otherwise("thin partitions"))
    )
    return (
        detail.filter(F.col("partition_column").isNotNull())
        .select("table_id", F.round(per, 2).alias("mb_per_partition"), reason.alias("reason"))
        .filter("reason IS NOT NULL")
    )


def layout_columns(stats: DataFrame, low_cardinality: int = 1000, least_rows: int = 100) -> DataFrame:
    """What each column of a large table is good for, from its measured values (``quality.column_stats``).

    ``partition`` by few values with many rows each; ``cluster`` by the others with more than one value.
    """
    rows_each = F.col("n") / F.col("ndv")
    role = (
        F.when(F.col("ndv") <= 1, "none")
        .when((F.col("ndv") <= low_cardinality) & (rows_each >= least_rows), "partition")
        .otherwise("cluster")
    )
    return stats.select("column", "ndv", role.alias("role"))


def layout_advice(detail: DataFrame, low_cardinality: int = 1000) -> DataFrame:
    """none under 1 TB, cluster to 100 TB, above that partition only by a column of few values."""
    advice = (
        F.when(F.col("size_bytes") < TB, "none")
        .when(F.col("size_bytes") < 100 * TB, "cluster")
        .when(F.col("num_partitions") <= low_cardinality, "partition")
        .otherwise("cluster")
    )
    return detail.select("table_id", advice.alias("advice"))


def _last(history: DataFrame, **operations: str) -> DataFrame:
    """Latest date of each operation per table, as one row per table."""
    return history.groupBy("table_id").agg(
        *[F.max(F.when(F.col("operation") == op, F.col("op_date"))).alias(name) for name, op in operations.items()]
    )


def stale_stats(history: DataFrame, detail: DataFrame, min_ratio: float = 0.1) -> DataFrame:
    """Tables never analyzed, or of whose rows at least ``min_ratio`` were changed by writes after the last analysis."""
    last = _last(history, analyzed="ANALYZE")
    since = (F.col("operation") == "WRITE") & (F.col("analyzed").isNull() | (F.col("op_date") > F.col("analyzed")))
    changed = (
        history.join(last, "table_id")
        .groupBy("table_id", "analyzed")
        .agg(F.sum(F.when(since, F.col("rows_changed")).otherwise(0)).alias("_changed"))
    )
    never = F.col("analyzed").isNull()
    ratio = F.round(F.try_divide(F.col("_changed").cast("double"), F.col("num_rows").cast("double")), 4)
    return (
        changed.join(detail.select("table_id", "num_rows"), "table_id", "left")
        .withColumn("changed_ratio", ratio)
        .filter(never | (F.col("changed_ratio") >= min_ratio))
        .select(
            "table_id",
            F.lit("stale_stats").alias("flag"),
            F.when(never, "never analyzed").otherwise("changed after analysis").alias("reason"),
            "changed_ratio",
        )
    )


def vacuum_policy(history: DataFrame, properties: DataFrame, as_of, max_age_days: int = 30) -> DataFrame:
    """Tables never or long not vacuumed, and tables keeping less than seven days; both give two rows."""
    cut = F.lit(as_date(as_of) - dt.timedelta(days=max_age_days))
    last = _last(history, vacuumed="VACUUM")
    overdue = (
        F.when(F.col("vacuumed").isNull(), "never vacuumed").when(F.col("vacuumed") < cut, "not vacuumed lately")
    )
    age = last.select("table_id", F.lit("vacuum").alias("flag"), overdue.alias("reason")).filter("reason IS NOT NULL")
    short = properties.filter(F.col("retention_days") < model.MIN_VACUUM_DAYS).select(
        "table_id", F.lit("retention").alias("flag"), F.lit("retention under seven days").alias("reason")
    )
    return age.unionByName(short)


def purge_before_vacuum(history: DataFrame) -> DataFrame:
    """Vacuumed tables whose soft deletes were not purged before the last vacuum."""
    last = _last(history, purged="PURGE", vacuumed="VACUUM").filter("vacuumed IS NOT NULL")
    reason = (
        F.when(F.col("purged").isNull(), "never purged").when(F.col("purged") > F.col("vacuumed"), "purged after vacuum")
    )
    return last.select("table_id", F.lit("purge_order").alias("flag"), reason.alias("reason")).filter(
        "reason IS NOT NULL"
    )


def maintenance_coverage(detail: DataFrame) -> DataFrame:
    return detail.filter(~F.coalesce("is_managed", F.lit(False))).select(
        "table_id", F.lit("uncovered").alias("flag"), F.lit("not a managed table").alias("reason")
    )
