"""Catalog hygiene: layers, names, comments, legacy and sprawling catalogs, lineage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.functions.common import breaks_naming, has_value, in_window, is_bronze, ratio


def bronze_layer_match(tables: DataFrame) -> DataFrame:
    tag = "layer_tag" if "layer_tag" in tables.columns else None
    return tables.select("table_id", is_bronze("schema_name", tag).alias("is_bronze"))


def _rate_by_layer(tables: DataFrame, bad, name: str) -> DataFrame:
    return (
        tables.groupBy("data_layer")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias(name))
        .withColumn("rate", ratio(F.col(name), F.col("n"), 4))
    )


def naming_violations(tables: DataFrame) -> DataFrame:
    return _rate_by_layer(tables, breaks_naming("table_name"), "violations")


def missing_comments(tables: DataFrame) -> DataFrame:
    return _rate_by_layer(tables, ~has_value("table_comment"), "missing")


def legacy_usage(
    tables: DataFrame, writes: DataFrame, as_of, legacy: tuple[str, ...] = ("hive_metastore",), days: int = 90
) -> DataFrame:
    """Tables left in legacy catalogs, split by whether anything still writes to them."""
    live = (
        writes.filter(in_window(writes, "event_time", as_of, days))
        .select("table_id", F.lit(True).alias("_live"))
        .distinct()
    )
    return (
        tables.filter(F.col("catalog_name").isin(*legacy))
        .select("catalog_name", "table_id")
        .join(live, "table_id", "left")
        .groupBy("catalog_name")
        .agg(F.count_if("_live").alias("active"), F.count_if(F.col("_live").isNull()).alias("idle"))
    )


def sprawl(tables: DataFrame, pattern: str = "^(dev|test|staging|prod)(_[a-z0-9]+)*$") -> DataFrame:
    """Layers and tables per catalog, and catalogs whose name follows no environment pattern."""
    by_layer = tables.groupBy("catalog_name", "data_layer").agg(F.count(F.lit(1)).alias("_n"))
    return (
        by_layer.groupBy("catalog_name")
        .agg(F.count("data_layer").alias("layers"), F.sum("_n").alias("tables"))
        .withColumn("off_pattern", ~F.col("catalog_name").rlike(pattern))
    )


def lineage_gap(tables: DataFrame, edges: DataFrame, writes: DataFrame, as_of, k: int = 2, days: int = 90) -> DataFrame:
    """Tables written lately that appear in fewer than ``k`` lineage edges."""
    live = writes.filter(in_window(writes, "event_time", as_of, days)).select("table_id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("table_id"))
    seen = ends.groupBy("table_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        tables.select("table_id")
        .join(live, "table_id", "left_semi")
        .join(seen, "table_id", "left")
        .select("table_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("edge_n"))
        .filter(F.col("edge_n") < k)
    )
