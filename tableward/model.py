"""Schemas and fixed vocabularies of the assessment tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies shared with the assessed platform's tables.
LAYERS = ["bronze", "silver", "gold"]
ACTIONS = ["INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE"]
RUN_STATUSES = ["succeeded", "failed", "cancelled"]
SEVERITIES = ["critical", "high", "medium"]
CATEGORIES = ["ETL Hygiene", "ML/AI Governance", "Ownership & Access", "Data Quality"]
DIMENSIONS = ["etl_hygiene", "ml_ai_governance", "ownership_access", "data_quality"]
ASSET_TYPES = ["table", "pipeline", "job", "ml_model", "ml_experiment"]
AD_HOC_ENTITY_TYPES = ["NOTEBOOK", "DBSQL_QUERY"]
NAMING_PATTERN = "^(raw|bronze|silver|gold)_[a-z0-9]+(_[a-z0-9]+)+$"

# Thresholds of the health rules.
FAILURE_CRITICAL = 0.35
FAILURE_WARNING = 0.15
EDIT_THRESHOLD = 20
OWNERSHIP_GOAL_PCT = 95.0
SCORE_CRITICAL_BELOW = 60
SCORE_WARNING_BELOW = 75
STALE_DAYS = 30
SMALL_FILE_MB = 100
MIN_VACUUM_DAYS = 7
SNIPPET_CHARS = 120


def schema(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no running session."""
    out = T.StructType()
    for pair in text.split(", "):
        name, kind = pair.split(" ")
        out.add(name, kind)
    return out


# Columns of the raw tables and of findings.
RAW_SCHEMAS = {
    "raw_ws_tables": schema(
        "table_id string, table_name string, catalog_name string, schema_name string, data_layer string, "
        "owner_email string, has_owner_tag boolean, table_comment string, naming_violation boolean, "
        "row_count_approx long, created_at timestamp, last_ddl_at timestamp"
    ),
    "raw_ws_pipelines": schema(
        "pipeline_id string, pipeline_name string, owner_email string, has_owner_tag boolean, "
        "is_production boolean, schedule_type string, has_dq_expectations boolean, "
        "uses_hardcoded_paths boolean, last_run_status string, last_run_date date, avg_duration_sec integer, "
        "created_at timestamp"
    ),
    "raw_ws_jobs": schema(
        "job_id string, job_name string, owner_email string, has_owner_tag boolean, schedule_cron string, "
        "cluster_type string, created_at timestamp"
    ),
    "raw_ws_job_runs": schema(
        "run_id string, job_id string, pipeline_id string, start_time timestamp, end_time timestamp, "
        "status string, duration_sec integer, triggered_by string"
    ),
    "raw_ws_audit_events": schema(
        "event_id string, event_time timestamp, user_email string, action_type string, table_id string, "
        "table_name string, data_layer string, bytes_affected long, query_snippet string"
    ),
    "raw_ws_ml_experiments": schema(
        "experiment_id string, experiment_name string, owner_email string, workspace_path string, "
        "last_run_date date, is_stale boolean, has_registered_model boolean, has_description boolean, "
        "created_at timestamp"
    ),
    "raw_ws_ml_models": schema(
        "model_id string, model_name string, serving_endpoint_name string, upstream_features_table string, "
        "features_table_layer string, last_training_date date, features_last_modified_date date, "
        "is_serving_stale_features boolean, owner_email string, registered_in_uc boolean"
    ),
}

FINDING_SCHEMA = schema(
    "finding_id string, severity string, category string, asset_type string, asset_name string, "
    "owner_email string, description string, business_impact_usd decimal(18,2), recommended_action string, "
    "detected_at date, sprint_estimate_days integer"
)
