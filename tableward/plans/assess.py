"""From raw platform tables to the five gold tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.functions.common import breaks_naming, has_value, in_window, is_false, is_true
from tableward.operators import backlog as B
from tableward.operators import direct_writes as D
from tableward.operators import governance as G
from tableward.operators import layout as Y
from tableward.operators import lineage as L
from tableward.operators import ml, ownership, pipelines, scoring
from tableward.operators import runs as R
from tableward.operators.ledger import with_first_seen
from tableward.session import keep

# Names of the raw tables.
RAW = (
    "raw_ws_tables",
    "raw_ws_pipelines",
    "raw_ws_jobs",
    "raw_ws_job_runs",
    "raw_ws_audit_events",
    "raw_ws_ml_experiments",
    "raw_ws_ml_models",
)


def assess(
    inputs: dict[str, DataFrame],
    as_of,
    price_per_hour: float = 1.0,
    detectors: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None,
    wanted: set[str] | None = None,
    detected: dict[str, DataFrame] | None = None,
    ledger: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Gold tables by name, and ``gold_table_dependents`` with a row per edited table and gold table that depends on it.

    The lineage walk, which starts at the edited tables only, and the edits run when called; the rest is lazy.
    ``inputs`` holds the seven raw tables and optionally ``lineage`` (source, target),
    ``reads`` (table_id, pipeline_id) or ready ``rerun_costs`` (table_id, rerun_cost_usd), ``ownership_history``
    (created_at, owned_at) and ``executive`` (table_id). Audit events without an ``entity_type`` count as direct writes; writes on
    tables of other layers than bronze don't count. Models name their features table by id or as catalog.schema.table.
    Jobs may have ``annual_cost_usd``. ``columns`` with ``column_tags`` and ``table_detail`` add findings on untagged columns and small files.
    ``detected`` has results of further detectors by name (``backlog.DETECTORS``): governance, layout and run habits. With the ``ledger`` of earlier
    runs (``operators.ledger``), findings are dated by the day they were first seen. ``detectors`` adds user findings: each takes the inputs and returns rows in the finding columns. Where ``wanted``
    names only tables that need neither edits nor findings, those are not computed.
    """
    missing = [name for name in RAW if name not in inputs]
    if missing:
        raise ValueError(f"missing inputs {missing}")
    tables, pipes, jobs, runs = (inputs[f"raw_ws_{n}"] for n in ("tables", "pipelines", "jobs", "job_runs"))
    events, experiments, models = (inputs[f"raw_ws_{n}"] for n in ("audit_events", "ml_experiments", "ml_models"))
    spark = tables.sparkSession
    if "entity_type" not in events.columns:
        events = events.withColumn("entity_type", F.lit(None).cast("string"))
    if "annual_cost_usd" not in jobs.columns:
        jobs = jobs.withColumn("annual_cost_usd", F.lit(0))
    edges = inputs.get("lineage", spark.createDataFrame([], "source string, target string"))
    reads = inputs.get("reads", spark.createDataFrame([], "table_id string, pipeline_id string"))
    executive = inputs.get("executive")

    health = pipelines.health(pipes, runs, as_of)
    history = inputs.get("ownership_history")
    if history is None:
        owned = F.when(F.col("has_owner_tag"), F.col("created_at"))
        history = pipes.filter("is_production").select("pipeline_id", "created_at", owned.alias("owned_at"))
    trend = ownership.trend(history, as_of)
    simple = {
        "gold_pipeline_health": health,
        "gold_ownership_trend": trend.select(
            "report_date",
            F.col("total").alias("total_production_pipelines"),
            F.col("owned").alias("owned_production_pipelines"),
            F.col("coverage_pct").alias("ownership_coverage_pct"),
            "goal_pct",
        ),
    }
    if wanted is not None and wanted <= simple.keys():
        return simple

    direct = D.direct_writes(events, tables)
    edited = keep(direct.filter(in_window(direct, "event_time", as_of, 90)).select("table_id").distinct(), "edited")
    reach = L.lineage_closure(edges, edited)
    feeds = D.feeding(reach, executive) if executive is not None else None
    costs = inputs.get("rerun_costs")
    if costs is None:
        # only edited tables have their cost in a gold table
        costs = L.rerun_cost(runs, reads.join(edited, "table_id", "left_semi"), as_of, price_per_hour)
    gold = tables.filter("data_layer = 'gold'").groupBy(F.col("table_id").alias("target")).agg(F.min("table_name").alias("_name"))
    downstream = reach.join(gold, "target").withColumn("target_name", F.coalesce("_name", "target")).drop("_name")
    where = tables.select("table_id", "table_name", F.concat_ws(".", "catalog_name", "schema_name").alias("catalog_schema"))
    edits = D.bronze_table_edits(direct, as_of, L.downstream_names(downstream), costs, feeds).join(where, "table_id", "left")
    edits = keep(edits, "edits")

    full_name = F.concat_ws(".", "catalog_name", "schema_name", "table_name")
    names = tables.select("table_id", F.explode(F.array(F.col("table_id"), full_name)).alias("_ref")).distinct()
    features = models.select(
        "model_id", "model_name", "owner_email", F.col("upstream_features_table").alias("_ref"),
        F.col("registered_in_uc").alias("is_registered"),
    ).join(names, "_ref", "left").drop("_ref")
    features = features.withColumnRenamed("table_id", "upstream_features_table")
    stale_models = ml.stale_feature_models(features, events, tables, as_of)
    more = []
    if "columns" in inputs and "column_tags" in inputs:
        more.append(B.column_findings(G.sensitive_name_scan(inputs["columns"], inputs["column_tags"]), as_of))
    if "table_detail" in inputs:
        more.append(B.layout_findings(Y.small_files(inputs["table_detail"]), as_of))
    found = B.remediation_backlog(
        B.edit_findings(edits, D.detected_at(direct, "table_id"), "table_name"),
        B.pipeline_findings(health, as_of, label="pipeline_name"),
        B.model_findings(features, stale_models, as_of, "model_name"),
        B.experiment_findings(ml.stale_experiments(experiments, as_of), as_of, "experiment_name"),
        B.experiment_rule_findings(experiments, as_of, "experiment_name"),
        B.table_findings(tables, as_of, "table_name"),
        B.job_findings(jobs, as_of, label="job_name"),
        B.run_findings(R.weekly_failures(runs, as_of), as_of),
        *B.detector_findings(detected or {}, as_of),
        *more,
        *[f(inputs) for f in (detectors or {}).values()],
    )
    if ledger is not None:
        found = with_first_seen(found, ledger)
    checks = scoring.all_checks(
        scoring.run_checks(runs, as_of),
        scoring.flag_checks(
            pipes,
            [
                (is_false("has_dq_expectations"), "etl_hygiene", "high"),
                (is_true("uses_hardcoded_paths"), "etl_hygiene", "high"),
            ],
            as_of,
        ),
        scoring.flag_checks(features, [(is_false("is_registered"), "ml_ai_governance", "high")], as_of),
        scoring.flag_checks(
            experiments,
            [
                (~has_value("owner_email"), "ml_ai_governance", "high"),
                (is_false("has_description"), "ml_ai_governance", "medium"),
            ],
            as_of,
        ),
        scoring.ownership_checks(trend),
        scoring.table_checks(tables, as_of),
    )
    return {
        "gold_health_scores": scoring.gold_health_scores(scoring.health_scores(checks), found),
        "gold_bronze_table_edits": edits,
        **simple,
        "gold_table_dependents": L.blast_radius(downstream),
        "gold_remediation_backlog": found,
    }


def naming_flags(tables: DataFrame) -> DataFrame:
    """Raw tables with ``naming_violation`` derived from the name."""
    return tables.withColumn("naming_violation", breaks_naming("table_name"))
