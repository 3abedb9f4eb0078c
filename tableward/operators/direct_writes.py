"""Direct writes to raw tables and what they put at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import in_window, is_direct_write
from tableward.functions.skew import with_rank_by_count


def direct_writes(writes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Writes on bronze tables that no pipeline or job made.

    With ``tables`` the layer comes from there; without, the writes are taken as bronze already.
    """
    hits = writes.filter(is_direct_write())
    if tables is not None:
        bronze = tables.filter(F.col("data_layer") == "bronze").select("table_id")
        hits = hits.join(bronze, "table_id", "left_semi")
    return hits


def severity(edit_count: Column, feeds_executive: Column, threshold: int = model.EDIT_THRESHOLD) -> Column:
    risky = (edit_count > threshold) | F.coalesce(feeds_executive, F.lit(False))
    return F.when(risky, "critical").otherwise("high")


def edit_counts(writes: DataFrame, as_of, days: int = 90, key: str = "table_name") -> DataFrame:
    """Number of direct edits and the latest one, per table; one pass with partial aggregation."""
    recent = writes.filter(is_direct_write() & in_window(writes, "event_time", as_of, days))
    latest = F.max_by(F.struct("user_email", "action_type", "event_time"), F.struct("event_time", "event_id"))
    return (
        recent.groupBy(key)
        .agg(F.count(F.lit(1)).alias("edit_count_90d"), latest.alias("_last"))
        .select(
            key,
            "edit_count_90d",
            F.col("_last.user_email").alias("last_editor_email"),
            F.to_date("_last.event_time").alias("last_edit_date"),
            F.col("_last.action_type").alias("last_action_type"),
        )
    )


def edit_severity(
    edits: DataFrame, threshold: int = model.EDIT_THRESHOLD, executive: DataFrame | None = None, key: str = "table_name"
) -> DataFrame:
    """Severity per edited table; ``executive`` lists the tables that feed executive reports."""
    feeds = F.lit(False)
    if executive is not None:
        edits = edits.join(executive.select(key).distinct().withColumn("_exec", F.lit(True)), key, "left")
        feeds = F.col("_exec")
    return edits.withColumn("severity", severity(F.col("edit_count_90d"), feeds, threshold)).drop("_exec")


def feeding(edges: DataFrame, targets: DataFrame, key: str = "table_id") -> DataFrame:
    """Tables with an edge into any of ``targets.table_id``."""
    wanted = targets.select(F.col("table_id").alias("target"))
    return edges.join(wanted, "target", "left_semi").select(F.col("source").alias(key)).distinct()


def edit_costs(
    writes: DataFrame, as_of, costs: DataFrame, executive: DataFrame | None = None, days: int = 90, threshold: int = model.EDIT_THRESHOLD
) -> DataFrame:
    """Count, severity and cost per edited table, where what lies downstream is not asked for."""
    joined = edit_counts(writes, as_of, days, "table_id").join(costs, "table_id", "left")
    cost = F.coalesce("rerun_cost_usd", F.lit(0).cast("decimal(18,2)")).alias("estimated_rerun_cost_usd")
    return edit_severity(joined, threshold, executive, "table_id").select("table_id", "edit_count_90d", cost, "severity")


def bronze_table_edits(
    writes: DataFrame,
    as_of,
    downstream: DataFrame,
    costs: DataFrame,
    executive: DataFrame | None = None,
    days: int = 90,
    threshold: int = model.EDIT_THRESHOLD,
) -> DataFrame:
    """One row per edited table, keyed by ``table_id``.

    ``downstream`` is the result of ``lineage.downstream_counts`` over edges into gold tables, or of ``lineage.downstream_names``, which
    adds ``downstream_gold_tables``, their names (missing where there are none); ``lineage.blast_radius`` has a row for each.
    """
    counts = edit_counts(writes, as_of, days, "table_id")
    renamed = {"downstream_count": "downstream_gold_table_count", "downstream_names": "downstream_gold_tables"}
    named = ["downstream_gold_tables"] if "downstream_names" in downstream.columns else []
    affected = downstream.withColumnsRenamed(renamed).select("table_id", "downstream_gold_table_count", *named)
    joined = counts.join(affected, "table_id", "left").join(costs, "table_id", "left")
    ranked = edit_severity(joined, threshold, executive, "table_id")
    return ranked.select(
        "table_id",
        "edit_count_90d",
        "last_editor_email",
        "last_edit_date",
        "last_action_type",
        F.coalesce("downstream_gold_table_count", F.lit(0)).cast("bigint").alias("downstream_gold_table_count"),
        *named,
        F.coalesce("rerun_cost_usd", F.lit(0).cast("decimal(18,2)")).alias("estimated_rerun_cost_usd"),
        "severity",
    )


def edits_by_user(writes: DataFrame, table: str | None = None) -> DataFrame:
    """Who wrote what and when; all tables, or one for a drill-down."""
    kept = writes if table is None else writes.filter(F.col("table_name") == table)
    return kept.groupBy(
        "table_name", "user_email", "action_type", F.to_date("event_time").alias("edit_date")
    ).agg(F.count(F.lit(1)).alias("n"))


def edit_action_mix(writes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("action_type") == a).alias(f"{a.lower()}_n") for a in model.ACTIONS]
    return writes.groupBy("table_name").agg(*counts)


def detected_at(writes: DataFrame, key: str = "table_name") -> DataFrame:
    """First day a direct write was seen."""
    return (
        writes.filter(is_direct_write()).groupBy(key).agg(F.to_date(F.min("event_time")).alias("detected_at"))
    )


def append_only_check(writes: DataFrame) -> DataFrame:
    """Tables whose log holds updates, deletes or truncates."""
    changing = writes.filter(F.col("action_type").isin("UPDATE", "DELETE", "TRUNCATE"))
    return changing.groupBy("table_name").agg(F.count(F.lit(1)).alias("violations"))


def access_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_email", "action_type", F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


def edits_ranked(edits: DataFrame, key: str = "table_name") -> DataFrame:
    return with_rank_by_count(edits.select(key, F.col("edit_count_90d").alias("edit_count")), "edit_count")


def edit_gap(edits: DataFrame, key: str = "table_name") -> DataFrame:
    """The most edited table against the runner-up."""
    top = edits.select(key, "edit_count_90d").orderBy(F.desc("edit_count_90d"), key).limit(2)
    first, second = F.max("edit_count_90d"), F.min("edit_count_90d")
    return top.agg(
        F.min_by(key, F.struct(-F.col("edit_count_90d"), F.col(key))).alias(key),
        first.alias("edit_count"),
        F.when(F.count(F.lit(1)) == 2, second).alias("runner_up"),
        F.when(F.count(F.lit(1)) == 2, F.round(first.cast("double") / second, 2)).alias("gap_ratio"),
    )


def edit_cost_table(edits: DataFrame, key: str = "table_id") -> DataFrame:
    """Critical tables with their cost and a TOTAL row."""
    critical = edits.filter(F.col("severity") == "critical")
    return (
        critical.rollup(key)
        .agg(
            F.sum("edit_count_90d").alias("edit_count_90d"),
            F.sum("estimated_rerun_cost_usd").cast("decimal(18,2)").alias("estimated_rerun_cost_usd"),
            F.grouping(key).alias("_total"),
        )
        .withColumn(key, F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(key)))
        .drop("_total")
    )


def rerun_cost_total(edits: DataFrame, only: str | None = None) -> DataFrame:
    kept = edits if only is None else edits.filter(F.col("severity") == only)
    return kept.agg(F.sum("estimated_rerun_cost_usd").alias("total_cost_usd"))
