"""The same queries as plain SQL, written separately, for checking against another engine.

``@name`` is an input of ``bindings``, ``#name`` a shared step below; both become named subqueries.
"""

from __future__ import annotations

import re

from tableward.plans.bindings import as_sql

DIRECT = "(entity_type IS NULL OR entity_type IN ('NOTEBOOK', 'DBSQL_QUERY'))"
NAME_OK = "'^(raw|bronze|silver|gold)_[a-z0-9]+(_[a-z0-9]+)+$'"
USER = "'^[^@ ]+@[^@ ]+[.][a-zA-Z]+$'"
SEV_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"

# Patterns of this side, written apart from those of the operators.
SENSITIVE_NAME = "(?i)(^|_)(ssn|email|dob|phone|address)(_|$)"
_CLASSES = {
    "email_address": r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_number": r"(^|[^\d])\(?\d\d\d\)?[-. ][-. ]?\d{3,4}[-. ]\d{4}([^\d]|$)",
    "card_number": r"(^|[^\d])\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}([^\d]|$)",
    "ip_address": r"(^|[^\d])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}([^\d]|$)",
    "us_ssn": r"(^|[^\d])\d{3}-\d\d-\d{4}([^\d]|$)",
}
_REPLACED = {
    "card_number": r"\d*\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\d*",
    "email_address": r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "us_ssn": r"\d{3}-\d\d-\d{4}",
    "ip_address": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "phone_number": r"\(?\d\d\d\)?[-. ][-. ]?\d{3,4}[-. ]\d{4}",
}
_OWN_RULES = {"license_line": "([lL]icen[cs]e|LICENSE)", "secret_key": "(AKIA|sk-|ghp_)[A-Za-z0-9]{8,}"}
GB1 = 1024 * 1024 * 1024
TB1 = 1024 * GB1


def _frac(part: str, whole: str, digits: int = 3) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), {digits})"


def _n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


def _rule(asset_type: str, asset: str, where: str, rule: str, sev: str, cat: str, text: str, action: str,
          days: int, impact: str, source: str, owner: str = "owner_email", seen: str = "DATE '2001-11-05'") -> str:
    key = f"concat('{cat}|{asset_type}|{rule}|', CAST({asset} AS VARCHAR))"
    return f"""
        SELECT concat('FND-', md5({key})) AS finding_id, {sev} AS severity, '{cat}' AS category,
               '{asset_type}' AS asset_type, CAST({asset} AS VARCHAR) AS asset_name,
               CAST({owner} AS VARCHAR) AS owner_email, {text} AS description,
               CAST({impact} AS DECIMAL(18,2)) AS business_impact_usd, '{action}' AS recommended_action,
               {seen} AS detected_at, {days} AS sprint_estimate_days
        FROM {source} WHERE {where}"""


def _habits(now: str) -> list[str]:
    """Findings that a detector's rows make as they are; ``now`` dates them."""
    found = [
        ("table", "catalog_name", "true", "legacy_catalog", "medium", "Data Quality", "Catalog is a legacy one", "Move its tables to a governed catalog", 5, "400",
         "(SELECT DISTINCT catalog_name FROM @tables WHERE catalog_name IN ('Brand#1', 'Brand#2', 'Brand#3')) x"),
        ("table", "catalog_name", "true", "catalog_name", "medium", "Data Quality", "Catalog name follows no environment pattern", "Rename or merge the catalog", 2, "100",
         "(SELECT DISTINCT catalog_name FROM @tables WHERE NOT regexp_matches(catalog_name, '^(dev|test|staging|prod)(_[a-z0-9]+)*$')) x"),
        ("table", "table_id", "true", "lineage_gap", "medium", "Data Quality", "Table is written to but hardly appears in lineage", "Write it through tracked pipelines", 2,
         "150", "#query_lineage_coverage_gap"),
        ("table", "concat(principal, '|', object, '|', privilege)", "true", "user_grant", "high", "Ownership & Access", "Grant is held by a named user",
         "Grant it to a group", 1, "200", "#query_offending_grants"),
        ("table", "table_id", "true", "creator_owned", "medium", "Ownership & Access", "Table still belongs to whoever created it", "Hand it over to a group", 1, "100",
         "#query_long_owned_by_creator"),
        ("ml_model", "model_id", "serving_endpoint_name IS NULL", "unused_model", "medium", "ML/AI Governance", "Model is served nowhere", "Serve the model or retire it",
         1, "300", "@models"),
        ("pipeline", "pipeline_id", "slope > 0 AND row_slope > 0 AND row_r2 >= 0.5", "full_rescan", "high", "ETL Hygiene",
         "Runs take longer with every row of the target", "Load only what is new", 5, "1200", "#query_full_rescan_signal"),
        ("pipeline", "pipeline_id", "true", "retries", "medium", "ETL Hygiene", "Pipeline was run again after failed or cancelled runs",
         "Make loads idempotent and watch retries", 2, "500", "(SELECT DISTINCT pipeline_id FROM #query_retry_after_failure) x"),
        ("pipeline", "pipeline_id", "true", "duplicate_load", "high", "ETL Hygiene", "A retry grew the target by more than an ordinary run",
         "Check for rows loaded twice", 3, "1500", "(SELECT DISTINCT pipeline_id FROM #query_duplicate_load_signal) x"),
        ("pipeline", "pipeline_id", "true", "external_database", "medium", "ETL Hygiene", "Pipeline reads straight from an external database",
         "Use a managed connector or change feed", 5, "600", "(SELECT DISTINCT pipeline_id FROM #query_external_db_ingest) x"),
        ("table", "table_id", "true", "over_partitioned", "medium", "ETL Hygiene", "Table has more partitions than its size warrants", "Cluster the table instead", 3, "250",
         "#query_over_partitioned"),
        ("table", "table_id", "true", "stale_stats", "medium", "ETL Hygiene", "Statistics are missing or out of date", "Analyze the table", 1, "100", "#query_stale_stats"),
        ("table", "table_id", "flag = 'vacuum'", "vacuum", "medium", "ETL Hygiene", "Table has not been vacuumed lately", "Vacuum the table on a schedule", 1, "80",
         "#query_vacuum_policy"),
        ("table", "table_id", "flag = 'retention'", "retention", "high", "ETL Hygiene", "Deleted files are kept for less than seven days",
         "Raise the retention to seven days or more", 1, "300", "#query_vacuum_policy"),
        ("table", "table_id", "true", "purge_order", "high", "Ownership & Access", "Soft deletes were not purged before the last vacuum", "Purge, then vacuum", 1, "350",
         "#query_purge_before_vacuum"),
        ("table", "table_id", "NOT is_managed", "unmaintained", "medium", "ETL Hygiene", "Table is outside automatic upkeep", "Make it a managed table", 2, "120",
         "@table_detail"),
        ("table", "object", "true", "unprotected", "critical", "Ownership & Access", "Table with telling columns has no policy", "Mask its columns or filter its rows", 2,
         "2500", "#query_unprotected_tables"),
    ]
    return [_rule(kind, asset, where, rule, f"'{sev}'", cat, f"'{text}'", action, days, impact, source, "NULL", now)
            for kind, asset, where, rule, sev, cat, text, action, days, impact, source in found]


_BACKLOG = " UNION ALL ".join(
    [
        *_habits("DATE '2001-11-05'"),
        _rule("table", "e.table_id", "true", "direct_writes", "severity", "ETL Hygiene",
              "concat(CAST(edit_count_90d AS VARCHAR), ' direct writes in the window')",
              "Take away direct write rights and route changes through a pipeline", 3, "estimated_rerun_cost_usd",
              f"""#edits e LEFT JOIN (SELECT table_id, CAST(min(event_time) AS DATE) AS first_day FROM @part_writes
                  WHERE {DIRECT} GROUP BY table_id) d ON e.table_id = d.table_id""", "NULL", "first_day"),
        _rule("pipeline", "pipeline_id", "failure_rate_30d > 0.35", "failing", "'critical'", "ETL Hygiene",
              "'Failure rate above the critical limit'", "Fix the failing step and add alerting", 3, "4000", "#health"),
        _rule("pipeline", "pipeline_id", "NOT has_owner_tag AND is_production", "unowned", "'high'",
              "Ownership & Access", "'Production pipeline has no owner'", "Assign an owner", 2, "2000", "#health"),
        _rule("pipeline", "pipeline_id", "NOT has_dq_expectations", "no_dq", "'high'", "ETL Hygiene",
              "'Pipeline has no data-quality rules'", "Add expectations", 3, "1000", "#health"),
        _rule("pipeline", "pipeline_id", "uses_hardcoded_paths", "paths", "'high'", "ETL Hygiene",
              "'Pipeline uses hard-coded paths'", "Move paths to parameters", 3, "1000", "#health"),
        _rule("ml_model", "model_id", "true", "stale_features", "'critical'", "ML/AI Governance",
              "'Model reads features from a raw table that was edited by hand'", "Retrain on silver features", 5,
              "5000", "#stale_models", "NULL", "CAST(last_write AS DATE)"),
        _rule("ml_model", "model_id", "NOT is_registered", "unregistered", "'high'", "ML/AI Governance",
              "'Model is not in the registry'", "Register the model", 4, "800", "@models"),
        _rule("ml_experiment", "experiment_id", "DATE '2001-08-02' - CAST(last_run_date AS DATE) > 30",
              "stale_experiment", "'high'", "ML/AI Governance", "'Experiment has not run lately'",
              "Archive or rerun the experiment", 2, "300", "@experiments_by_run", "NULL"),
        _rule("table", "table_id", f"NOT regexp_matches(table_name, {NAME_OK})", "naming", "'medium'", "Data Quality",
              "'Table name breaks the naming rule'", "Give the table a name of layer, domain and entity", 1, "100", "@tables"),
        _rule("table", "table_id", "data_layer = 'bronze' AND table_comment IS NULL", "comment", "'medium'",
              "Data Quality", "'Bronze table has no comment'", "Describe the table", 1, "50", "@tables"),
        _rule("job", "job_id", "cluster_type <> 'HOUSEHOLD'", "classic_compute", "'medium'", "ETL Hygiene",
              "'Job runs on self-managed compute'", "Move the job to managed compute", 2,
              "round(CAST(annual_cost_usd AS DOUBLE) * 0.4, 2)", "@jobs", "NULL"),
        _rule("job", "job_id", "owner_email IS NULL", "unowned", "'high'", "Ownership & Access", "'Job has no owner'",
              "Assign an owner", 2, "500", "@jobs"),
        _rule("table", "table_id", "owner_email IS NULL", "unowned", "'medium'", "Ownership & Access",
              "'Table has no owner'", "Assign an owner", 1, "200", "@tables"),
        _rule("ml_experiment", "experiment_id", "owner_email IS NULL", "unowned", "'medium'", "Ownership & Access",
              "'Experiment has no owner'", "Assign an owner", 1, "100", "@experiments"),
        _rule("ml_experiment", "experiment_id", "NOT has_description", "no_description", "'medium'", "ML/AI Governance",
              "'Experiment is not described'", "Describe the experiment", 1, "50", "@experiments"),
        _rule("ml_experiment", "experiment_id", "NOT has_registered_model", "no_model", "'medium'", "ML/AI Governance",
              "'Experiment has no registered model'", "Register its model or archive it", 2, "150", "@experiments"),
        _rule("table", "concat(object, '.', column_name)", "true", "untagged", "'high'", "Ownership & Access",
              "'Column with a telling name has no class tag'", "Tag the column and protect it", 1, "750", "#untagged", "NULL"),
        _rule("table", "table_id", "CAST(size_bytes AS DOUBLE) / num_files / 1048576.0e0 < 100", "small_files", "'medium'",
              "ETL Hygiene", "'Files are small on average'", "Compact the table", 1, "150", "@table_detail", "NULL"),
        _rule("pipeline", "pipeline_id", "weeks_with_failure >= 3", "weekly", "'high'", "ETL Hygiene",
              "'Pipeline fails week after week'", "Find the recurring cause", 3, "1500", "#weekly", "NULL"),
    ]
)


def _flag(source: str, bad: str, dimension: str, weight: int) -> str:
    return f"""SELECT d AS report_date, '{dimension}' AS dimension, {weight} AS weight, checked, violations
               FROM #score_days, (SELECT count(*) AS checked, {_n(bad)} AS violations FROM {source}) f"""


STEPS: dict[str, str] = {
    "event_edits": f"""
        SELECT c.table_name, edit_count_90d, user_email AS last_editor_email,
               CAST(event_time AS DATE) AS last_edit_date, action_type AS last_action_type
        FROM (SELECT table_name, user_email, event_time, action_type,
                     count(*) OVER (PARTITION BY table_name) AS edit_count_90d,
                     row_number() OVER (PARTITION BY table_name ORDER BY event_time DESC, event_id DESC) AS rn
              FROM @writes WHERE {DIRECT} AND event_time >= DATE '2023-11-02' AND event_time < DATE '2024-02-01') c
        WHERE rn = 1""",
    "blast": """
        SELECT source AS table_id, target AS downstream_table, count(*) OVER (PARTITION BY source) AS downstream_count
        FROM (SELECT DISTINCT source, target FROM @edges WHERE source <> target) x""",
    "gold_reach": """
        SELECT source AS table_id, count(DISTINCT target) AS n FROM @gold_edges WHERE source <> target GROUP BY source""",
    "cost": """
        SELECT r.table_id, CAST(sum(c.cost_usd) AS DECIMAL(18,2)) AS rerun_cost_usd
        FROM (SELECT DISTINCT table_id, pipeline_id FROM @reads) r JOIN (
            SELECT pipeline_id, CAST(round(f / n * (s / n / 3600.0e0) * (n * 365.0e0 / 90.0e0) * 0.5e0, 2)
                   AS DECIMAL(18,2)) AS cost_usd
            FROM (SELECT pipeline_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(duration_sec) AS DOUBLE) AS s,
                         CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) AS f
                  FROM @runs WHERE start_time >= DATE '2001-05-04' AND start_time < DATE '2001-08-03'
                  GROUP BY pipeline_id) x) c ON c.pipeline_id = r.pipeline_id
        GROUP BY r.table_id""",
    "edits": f"""
        SELECT c.table_id, c.edit_count_90d, c.user_email AS last_editor_email,
               CAST(c.event_time AS DATE) AS last_edit_date, c.action_type AS last_action_type,
               coalesce(b.n, 0) AS downstream_gold_table_count,
               CAST(coalesce(k.rerun_cost_usd, 0) AS DECIMAL(18,2)) AS estimated_rerun_cost_usd,
               CASE WHEN c.edit_count_90d > 3 OR x.source IS NOT NULL THEN 'critical' ELSE 'high' END AS severity
        FROM (SELECT table_id, user_email, event_time, action_type,
                     count(*) OVER (PARTITION BY table_id) AS edit_count_90d,
                     row_number() OVER (PARTITION BY table_id ORDER BY event_time DESC, event_id DESC) AS rn
              FROM @part_writes WHERE {DIRECT} AND event_time >= DATE '2001-08-07' AND event_time < DATE '2001-11-06') c
        LEFT JOIN #gold_reach b ON b.table_id = c.table_id
        LEFT JOIN #cost k ON k.table_id = c.table_id
        LEFT JOIN (SELECT DISTINCT source FROM @edges WHERE target IN (SELECT table_id FROM @exec_tables)) x
               ON x.source = c.table_id
        WHERE c.rn = 1""",
    "rates": f"""
        SELECT pipeline_id, count(*) AS total_runs, {_n("status = 'failed'")} AS failed_runs,
               {_frac("count(*) FILTER (WHERE status = 'failed')", "count(*)")} AS failure_rate
        FROM @runs WHERE start_time >= DATE '2001-07-03' AND start_time < DATE '2001-08-03' GROUP BY pipeline_id""",
    "rates_all": f"""
        SELECT pipeline_id, count(*) AS total_runs, {_n("status = 'failed'")} AS failed_runs,
               {_frac("count(*) FILTER (WHERE status = 'failed')", "count(*)")} AS failure_rate
        FROM @runs GROUP BY pipeline_id""",
    "health": """
        SELECT p.pipeline_id, pipeline_name, owner_email, has_owner_tag, is_production, has_dq_expectations,
               uses_hardcoded_paths, coalesce(failure_rate, 0.0e0) AS failure_rate_30d, avg_duration_sec,
               CASE WHEN has_owner_tag THEN 0 ELSE 1 END + CASE WHEN has_dq_expectations THEN 0 ELSE 1 END
                 + CASE WHEN uses_hardcoded_paths THEN 1 ELSE 0 END AS anti_pattern_count,
               CASE WHEN coalesce(failure_rate, 0) > 0.35 OR (NOT has_owner_tag AND is_production) THEN 'critical'
                    WHEN coalesce(failure_rate, 0) > 0.15 OR NOT has_dq_expectations THEN 'warning'
                    ELSE 'healthy' END AS health_status
        FROM @pipelines p LEFT JOIN #rates r ON p.pipeline_id = r.pipeline_id""",
    "stale_models": f"""
        SELECT m.model_id, m.upstream_features_table AS features_table, max(w.event_time) AS last_write
        FROM @models m JOIN @tables t ON t.table_id = m.upstream_features_table AND t.data_layer = 'bronze'
        JOIN @part_writes w ON w.table_id = t.table_id
        WHERE {DIRECT} AND w.event_time >= DATE '2001-10-06' AND w.event_time < DATE '2001-11-06' GROUP BY ALL""",
    "trend": f"""
        SELECT d AS report_date, CAST(count(*) FILTER (WHERE CAST(created_at AS DATE) <= d) AS BIGINT) AS total,
               CAST(count(*) FILTER (WHERE CAST(greatest(created_at, owned_at) AS DATE) <= d AND owned_at IS NOT NULL)
                 AS BIGINT) AS owned,
               {_frac("100 * count(*) FILTER (WHERE CAST(greatest(created_at, owned_at) AS DATE) <= d AND owned_at IS NOT NULL)",
                      "count(*) FILTER (WHERE CAST(created_at AS DATE) <= d)", 2)} AS coverage_pct,
               95.0e0 AS goal_pct
        FROM @ownership_history, (SELECT CAST(g AS DATE) AS d FROM generate_series(TIMESTAMP '1996-06-01',
             TIMESTAMP '1996-07-01', INTERVAL '1' DAY) t(g)) s GROUP BY d""",
    "backlog": _BACKLOG,
    "score_days": """
        SELECT CAST(g AS DATE) AS d FROM generate_series(TIMESTAMP '2001-07-03', TIMESTAMP '2001-08-02',
             INTERVAL '1' DAY) t(g)""",
    "checks": " UNION ALL ".join(
        [
            f"""SELECT d AS report_date, 'etl_hygiene' AS dimension, 3 AS weight, count(pipeline_id) AS checked,
                       {_n("status = 'failed'")} AS violations
                FROM #score_days LEFT JOIN @runs ON CAST(start_time AS DATE) <= d AND CAST(start_time AS DATE) > d - 30
                GROUP BY d""",
            _flag("@pipelines", "NOT has_dq_expectations", "etl_hygiene", 2),
            _flag("@pipelines", "uses_hardcoded_paths", "etl_hygiene", 2),
            _flag("@models", "NOT is_registered", "ml_ai_governance", 2),
            _flag("@models", "serving_endpoint_name IS NULL", "ml_ai_governance", 1),
            """SELECT d, 'ownership_access', 2, count(*) FILTER (WHERE CAST(created_at AS DATE) <= d),
                      count(*) FILTER (WHERE CAST(created_at AS DATE) <= d)
                        - count(*) FILTER (WHERE owned_at IS NOT NULL AND CAST(greatest(created_at, owned_at) AS DATE) <= d)
               FROM #score_days, @ownership_history GROUP BY d""",
            f"""SELECT d, 'data_quality', 1, 2 * count(table_id),
                       count(*) FILTER (WHERE NOT regexp_matches(table_name, {NAME_OK}))
                         + count(*) FILTER (WHERE table_id IS NOT NULL AND table_comment IS NULL)
                FROM #score_days LEFT JOIN @tables ON created_at <= d GROUP BY d""",
        ]
    ),
    "dimension_scores": """
        SELECT report_date, dimension, CAST((200 * (c - v) + c) // (2 * c) AS BIGINT) AS score
        FROM (SELECT report_date, dimension, CAST(sum(weight * checked) AS BIGINT) AS c,
                     CAST(sum(weight * violations) AS BIGINT) AS v FROM #checks GROUP BY ALL) x""",
    "scores": """
        SELECT report_date, dimension, score FROM #dimension_scores
        UNION ALL
        SELECT report_date, 'overall', CAST(floor(avg(score) + 0.5) AS BIGINT) FROM #dimension_scores GROUP BY ALL""",
    "classified": " UNION ALL ".join(
        f"""SELECT '{obj}' AS object, '{column}' AS column_name, '{rule}' AS rule,
                   {_n(f"regexp_matches({column}, '{pattern}')")} AS hits,
                   {_frac(f"count(*) FILTER (WHERE regexp_matches({column}, '{pattern}'))", f"count({column})", 6)} AS hit_rate
            FROM @{obj}"""
        for obj, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"))
        for rule, pattern in _CLASSES.items()
    ),
    "untagged": f"""SELECT object, column_name FROM @columns c
        WHERE regexp_matches(column_name, '{SENSITIVE_NAME}') AND NOT EXISTS (
            SELECT 1 FROM @column_tags t WHERE t.object = c.object AND t.column_name = c.column_name)""",
    "weekly": """SELECT pipeline_id, count(DISTINCT date_trunc('week', start_time)) AS weeks_with_failure
        FROM @runs WHERE status = 'failed' AND start_time >= DATE '2000-07-31' AND start_time < DATE '2001-07-30'
        GROUP BY pipeline_id""",
    "last_ops": """
        SELECT table_id, max(op_date) FILTER (WHERE operation = 'ANALYZE') AS analyzed,
               max(op_date) FILTER (WHERE operation = 'WRITE') AS changed,
               max(op_date) FILTER (WHERE operation = 'PURGE') AS purged,
               max(op_date) FILTER (WHERE operation = 'VACUUM') AS vacuumed
        FROM @table_history GROUP BY table_id""",
    "stepped": """
        SELECT pipeline_id, run_id, start_time, status, duration_sec, lag(status) OVER w AS prev_status,
               duration_sec - lag(duration_sec) OVER w AS growth
        FROM @runs WINDOW w AS (PARTITION BY pipeline_id ORDER BY start_time, run_id)""",
}

_NOW = "DATE '2001-08-02'"


def _named(sql: str, name: str) -> str:
    """The finding with the asset's label instead of its key."""
    key = re.search(r"CAST\((\S+) AS VARCHAR\) AS asset_name", sql)[0]
    return sql.replace(key, f"coalesce({name}, {key.removesuffix(' AS asset_name')}) AS asset_name")


_GOLD_BACKLOG = " UNION ALL ".join(
    [
        *_habits(_NOW),
        _rule("pipeline", "pipeline_id", "weeks_with_failure >= 3", "weekly", "'high'", "ETL Hygiene",
              "'Pipeline fails week after week'", "Find the recurring cause", 3, "1500", "#weekly", "NULL", _NOW),
        _rule("table", "concat(object, '.', column_name)", "true", "untagged", "'high'", "Ownership & Access",
              "'Column with a telling name has no class tag'", "Tag the column and protect it", 1, "750", "#untagged", "NULL", _NOW),
        _rule("table", "table_id", "CAST(size_bytes AS DOUBLE) / num_files / 1048576.0e0 < 100", "small_files", "'medium'",
              "ETL Hygiene", "'Files are small on average'", "Compact the table", 1, "150", "@table_detail", "NULL", _NOW),
        _named(_rule("table", "e.table_id", "true", "direct_writes", "severity", "ETL Hygiene",
              "concat(CAST(edit_count_90d AS VARCHAR), ' direct writes in the window')",
              "Take away direct write rights and route changes through a pipeline", 3, "estimated_rerun_cost_usd",
              f"""#gold_edits e LEFT JOIN (SELECT table_id, CAST(min(event_time) AS DATE) AS first_day FROM @part_writes
                  WHERE {DIRECT} GROUP BY table_id) d ON e.table_id = d.table_id""", "NULL", "first_day"), "table_name"),
        *(
            _named(_rule("pipeline", "pipeline_id", where, rule, sev, cat, text, action, days, impact, "#health", seen=_NOW), "pipeline_name")
            for where, rule, sev, cat, text, action, days, impact in (
                ("failure_rate_30d > 0.35", "failing", "'critical'", "ETL Hygiene", "'Failure rate above the critical limit'",
                 "Fix the failing step and add alerting", 3, "4000"),
                ("NOT has_owner_tag AND is_production", "unowned", "'high'", "Ownership & Access",
                 "'Production pipeline has no owner'", "Assign an owner", 2, "2000"),
                ("NOT has_dq_expectations", "no_dq", "'high'", "ETL Hygiene", "'Pipeline has no data-quality rules'",
                 "Add expectations", 3, "1000"),
                ("uses_hardcoded_paths", "paths", "'high'", "ETL Hygiene", "'Pipeline uses hard-coded paths'",
                 "Move paths to parameters", 3, "1000"),
            )
        ),
        _named(_rule("ml_model", "model_id", "true", "stale_features", "'critical'", "ML/AI Governance",
              "'Model reads features from a raw table that was edited by hand'", "Retrain on silver features", 5, "5000",
              f"""(SELECT m.model_id, m.model_name, max(w.event_time) AS last_write FROM @platform_models m
                  JOIN @platform_tables t ON t.table_id = m.upstream_features_table AND t.data_layer = 'bronze'
                  JOIN @part_writes w ON w.table_id = t.table_id WHERE {DIRECT} AND w.event_time >= DATE '2001-07-03'
                  AND w.event_time < DATE '2001-08-03' GROUP BY ALL) s""", "NULL", "CAST(last_write AS DATE)"), "model_name"),
        _named(_rule("ml_model", "model_id", "NOT registered_in_uc", "unregistered", "'high'", "ML/AI Governance",
              "'Model is not in the registry'", "Register the model", 4, "800", "@platform_models", seen=_NOW), "model_name"),
        _named(_rule("ml_experiment", "experiment_id", f"last_run_date IS NULL OR {_NOW} - CAST(last_run_date AS DATE) > 30",
              "stale_experiment", "'high'", "ML/AI Governance", "'Experiment has not run lately'",
              "Archive or rerun the experiment", 2, "300", "@platform_experiments", "NULL", _NOW), "experiment_name"),
        *(
            _named(_rule("ml_experiment", "experiment_id", where, rule, "'medium'", cat, text, action, days, impact,
                         "@platform_experiments", seen=_NOW), "experiment_name")
            for where, rule, cat, text, action, days, impact in (
                ("owner_email IS NULL", "unowned", "Ownership & Access", "'Experiment has no owner'", "Assign an owner", 1, "100"),
                ("NOT has_description", "no_description", "ML/AI Governance", "'Experiment is not described'",
                 "Describe the experiment", 1, "50"),
                ("NOT has_registered_model", "no_model", "ML/AI Governance", "'Experiment has no registered model'",
                 "Register its model or archive it", 2, "150"),
            )
        ),
        *(
            _named(_rule("table", "table_id", where, rule, "'medium'", cat, text, action, 1, impact, "@platform_tables",
                         seen=_NOW), "table_name")
            for where, rule, cat, text, action, impact in (
                (f"NOT regexp_matches(table_name, {NAME_OK})", "naming", "Data Quality", "'Table name breaks the naming rule'",
                 "Give the table a name of layer, domain and entity", "100"),
                ("data_layer = 'bronze' AND table_comment IS NULL", "comment", "Data Quality", "'Bronze table has no comment'",
                 "Describe the table", "50"),
                ("owner_email IS NULL", "unowned", "Ownership & Access", "'Table has no owner'", "Assign an owner", "200"),
            )
        ),
        _named(_rule("job", "job_id", "true", "classic_compute", "'medium'", "ETL Hygiene", "'Job runs on self-managed compute'",
              "Move the job to managed compute", 2, "round(CAST(annual_cost_usd AS DOUBLE) * 0.4, 2)", "@jobs", "NULL", _NOW), "job_name"),
        _named(_rule("job", "job_id", "owner_email IS NULL", "unowned", "'high'", "Ownership & Access", "'Job has no owner'",
              "Assign an owner", 2, "500", "@jobs", seen=_NOW), "job_name"),
    ]
)

STEPS["gold_edits"] = f"""
    SELECT c.table_id, c.edit_count_90d, c.user_email AS last_editor_email, CAST(c.event_time AS DATE) AS last_edit_date,
           c.action_type AS last_action_type, coalesce(g.n, 0) AS downstream_gold_table_count,
           CAST(coalesce(k.rerun_cost_usd, 0) AS DECIMAL(18,2)) AS estimated_rerun_cost_usd,
           CASE WHEN c.edit_count_90d > 20 OR x.source IS NOT NULL THEN 'critical' ELSE 'high' END AS severity,
           t.table_name, concat(t.catalog_name, '.', t.schema_name) AS catalog_schema
    FROM (SELECT *, count(*) OVER (PARTITION BY table_id) AS edit_count_90d,
                 row_number() OVER (PARTITION BY table_id ORDER BY event_time DESC, event_id DESC) AS rn
          FROM @part_writes WHERE {DIRECT} AND event_time >= DATE '2001-05-04' AND event_time < DATE '2001-08-03') c
    JOIN @platform_tables t ON t.table_id = c.table_id AND t.data_layer = 'bronze'
    LEFT JOIN (SELECT table_id, count(*) AS n FROM #gold_dependents GROUP BY table_id) g ON g.table_id = c.table_id
    LEFT JOIN #cost k ON k.table_id = c.table_id
    LEFT JOIN (SELECT DISTINCT source FROM @edges WHERE target IN (SELECT table_id FROM @exec_tables)) x
           ON x.source = c.table_id
    WHERE c.rn = 1"""
STEPS["gold_dependents"] = """
    SELECT a.source AS table_id, b.target AS downstream_table FROM @edges a JOIN @edges b ON b.source = a.target
    UNION
    SELECT a.source, c.target FROM @edges a JOIN @edges b ON b.source = a.target JOIN @edges c ON c.source = b.target"""
STEPS["gold_backlog"] = _GOLD_BACKLOG
STEPS["gold_trend"] = f"""
    SELECT d AS report_date, CAST(count(*) FILTER (WHERE CAST(created_at AS DATE) <= d) AS BIGINT) AS total_production_pipelines,
           CAST(count(*) FILTER (WHERE owned_at IS NOT NULL AND CAST(greatest(created_at, owned_at) AS DATE) <= d) AS BIGINT)
               AS owned_production_pipelines,
           {_frac("100 * count(*) FILTER (WHERE owned_at IS NOT NULL AND CAST(greatest(created_at, owned_at) AS DATE) <= d)",
                  "count(*) FILTER (WHERE CAST(created_at AS DATE) <= d)", 2)} AS ownership_coverage_pct,
           95.0e0 AS goal_pct
    FROM @production_history, #score_days GROUP BY d"""
STEPS["gold_checks"] = " UNION ALL ".join(
    [
        f"""SELECT d AS report_date, 'etl_hygiene' AS dimension, 3 AS weight, count(pipeline_id) AS checked,
                   {_n("status = 'failed'")} AS violations
            FROM #score_days LEFT JOIN @runs ON CAST(start_time AS DATE) <= d AND CAST(start_time AS DATE) > d - 30
            GROUP BY d""",
        _flag("@pipelines", "NOT has_dq_expectations", "etl_hygiene", 2),
        _flag("@pipelines", "uses_hardcoded_paths", "etl_hygiene", 2),
        _flag("@platform_models", "NOT registered_in_uc", "ml_ai_governance", 2),
        _flag("@platform_experiments", "owner_email IS NULL", "ml_ai_governance", 2),
        _flag("@platform_experiments", "NOT has_description", "ml_ai_governance", 1),
        """SELECT report_date, 'ownership_access', 2, total_production_pipelines,
                  total_production_pipelines - owned_production_pipelines FROM #gold_trend""",
        f"""SELECT d, 'data_quality', 1, 2 * count(table_id), count(*) FILTER (WHERE NOT regexp_matches(table_name, {NAME_OK}))
                  + count(*) FILTER (WHERE table_id IS NOT NULL AND table_comment IS NULL)
            FROM #score_days LEFT JOIN @platform_tables ON created_at <= d GROUP BY d""",
    ]
)
STEPS["gold_dimension_scores"] = STEPS["dimension_scores"].replace("#checks", "#gold_checks")
STEPS["gold_scores"] = STEPS["scores"].replace("#dimension_scores", "#gold_dimension_scores")

_FAILED_RULES = {
    "short_run": "duration_sec <= 400000",
    "not_cancelled": "status <> 'cancelled'",
    "after_1996": "start_time >= DATE '1996-01-01'",
}
_BAD_VALUE = "try_cast(value AS DOUBLE) IS NULL"
_RESCUE = """concat('{', CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN concat('"value":"', value, '",') ELSE '' END,
             '"props":"', replace(props, '"', '\\"'), '"}')"""
_BRIEF = "finding_id, severity, asset_name, business_impact_usd, sprint_estimate_days"


def _masked(source: str, key: str, column: str) -> str:
    """One subquery per class; a class is replaced where it is found often enough."""
    out = f"SELECT {key}, {column} FROM {source}"
    for name, pattern in _REPLACED.items():
        often = f"(SELECT hit_rate >= 0.005 FROM #classified WHERE object = 'documents' AND rule = '{name}')"
        out = f"SELECT {key}, CASE WHEN {often} THEN regexp_replace({column}, '{pattern}', '***', 'g') ELSE {column} END AS {column} FROM ({out}) m"
    return out


def _checked_hits(obj: str, column: str, rule: str) -> str:
    """Texts with a value of a class that can exist; candidates as rows, one class at a time."""
    text = f"(SELECT row_number() OVER () AS k, {column} AS t FROM @{obj})"
    piece = "SELECT k, unnest(string_split_regex(t, '{}')) AS p FROM " + text
    if rule == "card_number":
        groups = f"SELECT k, [x FOR x IN string_split_regex(p, '[ -]+') IF x <> ''] AS g FROM ({piece.format('[^0-9 -]+')}) WHERE length(p) >= 16"
        windows = f"SELECT k, g, unnest(range(1, len(g) + 1)) AS i FROM ({groups})"
        cards = f"""SELECT k, CASE WHEN length(g[i]) = 16 THEN g[i] WHEN length(g[i]) = 4 AND length(g[i + 1]) = 4 AND length(g[i + 2]) = 4
            AND length(g[i + 3]) = 4 THEN g[i] || g[i + 1] || g[i + 2] || g[i + 3] END AS c FROM ({windows})"""
        digit = f"SELECT k, c, unnest(range(1, 17)) AS n FROM (SELECT DISTINCT k, c FROM ({cards}) WHERE c IS NOT NULL)"
        found = f"""SELECT k FROM (SELECT k, c, CAST(substr(c, n, 1) AS INT) * (1 + n % 2) AS d FROM ({digit}))
            GROUP BY k, c HAVING sum(CASE WHEN d > 9 THEN d - 9 ELSE d END) % 10 = 0"""
    elif rule == "ip_address":
        found = f"""SELECT k FROM (SELECT k, trim(p, '.') AS p FROM ({piece.format("[^0-9.]+")}))
            WHERE regexp_full_match(p, '((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])[.]){{3}}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])')"""
    elif rule == "us_ssn":
        found = f"""SELECT k FROM (SELECT k, trim(p, '-') AS p FROM ({piece.format("[^0-9-]+")})) WHERE regexp_full_match(p, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')
            AND substr(p, 1, 3) NOT IN ('000', '666') AND substr(p, 1, 3) < '900' AND substr(p, 5, 2) <> '00' AND substr(p, 8) <> '0000'"""
    else:
        found = f"SELECT k FROM {text} WHERE regexp_matches(t, '{_CLASSES[rule]}')"
    hits = f"(SELECT count(DISTINCT k) FROM ({found}))"
    return f"SELECT '{obj}' AS object, '{column}' AS column_name, '{rule}' AS rule, {hits} AS hits, {_frac(hits, f'count({column})', 6)} AS hit_rate FROM @{obj}"


def _stats(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS n, count(*) - count({column}) AS nulls,
                      count(DISTINCT {column}) AS ndv, CAST(min({column}) AS VARCHAR) AS "min",
                      CAST(max({column}) AS VARCHAR) AS "max" FROM @part"""


ORACLE: dict[str, str] = {
    "direct_writes": f"""SELECT table_id, event_time, user_email, entity_type FROM @part_writes
        WHERE {DIRECT} AND table_id IN (SELECT table_id FROM @tables WHERE data_layer = 'bronze')""",
    "direct_writes_audit": f"SELECT table_name, event_time, user_email, entity_type FROM @writes WHERE {DIRECT}",
    "bronze_layer_match": """SELECT table_id, ends_with(schema_name, '_bronze') OR coalesce(layer_tag = 'bronze', false)
        AS is_bronze FROM @tables""",
    "bronze_table_edits": "SELECT * FROM #edits",
    "bronze_table_edits_audit": "SELECT * FROM #event_edits",
    "edit_severity": """SELECT table_name, edit_count_90d, CASE WHEN edit_count_90d > 15 THEN 'critical' ELSE 'high' END
        AS severity FROM #event_edits""",
    "edit_severity_7d": f"""SELECT table_name, count(*) AS edit_count_90d,
        CASE WHEN count(*) > 5 THEN 'critical' ELSE 'high' END AS severity
        FROM @writes WHERE {DIRECT} AND event_time >= DATE '2024-01-24' AND event_time < DATE '2024-02-01'
        GROUP BY table_name""",
    "edits_by_user": """SELECT table_name, user_email, action_type, CAST(event_time AS DATE) AS edit_date, count(*) AS n
        FROM @writes GROUP BY ALL""",
    "edit_action_mix": f"""SELECT table_name, {_n("action_type = 'INSERT'")} AS insert_n,
        {_n("action_type = 'UPDATE'")} AS update_n, {_n("action_type = 'DELETE'")} AS delete_n,
        {_n("action_type = 'MERGE'")} AS merge_n, {_n("action_type = 'TRUNCATE'")} AS truncate_n
        FROM @writes GROUP BY table_name""",
    "detected_at": f"""SELECT table_name, CAST(min(event_time) AS DATE) AS detected_at FROM @writes WHERE {DIRECT}
        GROUP BY table_name""",
    "append_only_check": """SELECT table_name, count(*) AS violations FROM @writes
        WHERE action_type IN ('UPDATE', 'DELETE', 'TRUNCATE') GROUP BY table_name""",
    "access_summary": """SELECT user_email, action_type, CAST(event_time AS DATE) AS day, count(*) AS n FROM @writes
        GROUP BY ALL""",
    "edits_ranked": """SELECT table_name, edit_count_90d AS edit_count, rank() OVER (ORDER BY edit_count_90d DESC) AS rank
        FROM #event_edits""",
    "edit_gap": f"""SELECT table_name, edit_count, runner_up, round(CAST(edit_count AS DOUBLE) / runner_up, 2) AS gap_ratio
        FROM (SELECT table_name, edit_count_90d AS edit_count,
                     lead(edit_count_90d) OVER (ORDER BY edit_count_90d DESC, table_name) AS runner_up,
                     row_number() OVER (ORDER BY edit_count_90d DESC, table_name) AS rn FROM #event_edits) x
        WHERE rn = 1""",
    "bronze_edit_cost_table": """
        SELECT table_id, edit_count_90d, estimated_rerun_cost_usd FROM #edits WHERE severity = 'critical'
        UNION ALL
        SELECT 'TOTAL', CAST(sum(edit_count_90d) AS BIGINT), CAST(sum(estimated_rerun_cost_usd) AS DECIMAL(18,2))
        FROM #edits WHERE severity = 'critical'""",
    "rerun_cost_total": "SELECT CAST(sum(estimated_rerun_cost_usd) AS DECIMAL(28,2)) AS total_cost_usd FROM #edits",
    "rerun_cost_total_critical": """SELECT CAST(sum(estimated_rerun_cost_usd) AS DECIMAL(28,2)) AS total_cost_usd FROM #edits
        WHERE severity = 'critical'""",
    "blast_radius": "SELECT * FROM #blast",
    "lineage_closure": """SELECT source, target, min(depth) AS min_depth FROM walk WHERE source <> target
        GROUP BY source, target""",
    "rerun_cost": "SELECT * FROM #cost",
    "maintenance_priority": """SELECT table_id, degree, rank() OVER (ORDER BY degree DESC) AS rank FROM (
        SELECT t.table_id, count(e.node) AS degree FROM @tables t LEFT JOIN (
            SELECT source AS node FROM @edges UNION ALL SELECT target FROM @edges) e ON e.node = t.table_id
        GROUP BY t.table_id) x""",
    "blocked_dependents": """SELECT source AS asset_id, count(DISTINCT target) AS dependents FROM @edges
        WHERE source IN (SELECT table_id FROM @tables WHERE owner_email IS NULL) GROUP BY source""",
    "pipeline_failure_rate": "SELECT * FROM #rates",
    "pipeline_failure_rate_all": "SELECT * FROM #rates_all",
    "pipeline_anti_pattern_count": "SELECT pipeline_id, anti_pattern_count FROM #health",
    "pipeline_health_basic": """SELECT p.pipeline_id, coalesce(failure_rate, 0.0e0) AS failure_rate_30d,
        CASE WHEN failure_rate > 0.35 THEN 'critical' WHEN failure_rate > 0.15 OR NOT has_owner_tag THEN 'warning'
             ELSE 'healthy' END AS health_status
        FROM @pipelines p LEFT JOIN #rates_all r ON p.pipeline_id = r.pipeline_id""",
    "pipeline_health_strict": "SELECT pipeline_id, failure_rate_30d, health_status FROM #health",
    "pipeline_health": "SELECT * FROM #health",
    "pipeline_run_status": """SELECT pipeline_id, CASE WHEN failure_rate > 0.35 THEN 'failed'
        WHEN failure_rate > 0.15 THEN 'warning' ELSE 'succeeded' END AS run_status FROM #rates""",
    "top_failing_pipelines": """SELECT pipeline_id, failure_rate_30d, health_status FROM #health
        WHERE failure_rate_30d > 0 ORDER BY failure_rate_30d DESC, pipeline_id LIMIT 15""",
    "pipelines_without_dq": "SELECT pipeline_id FROM @pipelines WHERE NOT has_dq_expectations",
    "hardcoded_paths": "SELECT pipeline_id FROM @pipelines WHERE uses_hardcoded_paths",
    "classic_compute_jobs": """SELECT cluster_type, count(*) AS n,
        round(CAST(sum(annual_cost_usd) AS DOUBLE) * 0.4, 2) AS est_saving
        FROM @jobs WHERE cluster_type <> 'HOUSEHOLD' GROUP BY cluster_type""",
    "full_rescan_signal": """SELECT pipeline_id, count(*) AS n,
        CASE WHEN min(x) < max(x) THEN round(regr_slope(y, x), 4) END AS slope,
        CASE WHEN min(x) < max(x) THEN round(regr_r2(y, x), 4) END AS r2,
        CASE WHEN min(r) < max(r) THEN round(regr_slope(y, r), 4) END AS row_slope,
        CASE WHEN min(r) < max(r) THEN round(regr_r2(y, r), 4) END AS row_r2 FROM (
            SELECT pipeline_id, CAST(duration_sec AS DOUBLE) AS y, epoch(start_time) / 86400.0e0 AS x,
                   CAST(table_rows AS DOUBLE) AS r FROM @runs) z
        GROUP BY pipeline_id HAVING count(*) >= 5""",
    "retry_after_failure": """SELECT run_id, pipeline_id, prev_status FROM #stepped
        WHERE prev_status IN ('failed', 'cancelled')""",
    "duplicate_load_signal": """SELECT * FROM (
        SELECT s.pipeline_id, s.run_id, CAST(s.growth AS DOUBLE) AS growth,
               round(CAST(s.growth AS DOUBLE) / u.usual, 3) AS ratio
        FROM #stepped s JOIN (
            SELECT pipeline_id, CAST(quantile_disc(growth, 0.5) AS DOUBLE) AS usual FROM #stepped
            WHERE prev_status = 'succeeded' AND growth > 0 GROUP BY pipeline_id) u ON u.pipeline_id = s.pipeline_id
        WHERE s.prev_status IN ('failed', 'cancelled')) x WHERE ratio > 1.5""",
    "write_path_mix": f"""SELECT table_name,
        {_frac("count(*) FILTER (WHERE entity_type = 'PIPELINE')", "count(*)", 4)} AS pipeline_share,
        {_frac("count(*) FILTER (WHERE entity_type = 'JOB')", "count(*)", 4)} AS job_share,
        {_frac(f"count(*) FILTER (WHERE {DIRECT})", "count(*)", 4)} AS adhoc_share
        FROM @writes GROUP BY table_name""",
    "external_db_ingest": """SELECT DISTINCT entity_id AS pipeline_id, source FROM @ingest_lineage
        WHERE source_kind = 'external_database' AND entity_type IN ('PIPELINE', 'JOB')
          AND entity_id IN (SELECT pipeline_id FROM @pipelines)""",
    "run_status_mix": f"""SELECT triggered_by,
        {_frac("count(*) FILTER (WHERE status = 'succeeded')", "count(*)", 4)} AS succeeded,
        {_frac("count(*) FILTER (WHERE status = 'failed')", "count(*)", 4)} AS failed,
        {_frac("count(*) FILTER (WHERE status = 'cancelled')", "count(*)", 4)} AS cancelled
        FROM @runs GROUP BY triggered_by""",
    "weekly_failures": """SELECT pipeline_id, count(DISTINCT date_trunc('week', start_time)) AS weeks_with_failure,
        count(DISTINCT date_trunc('week', start_time)) >= 52 AS every_week
        FROM @runs WHERE status = 'failed' AND start_time >= DATE '2000-07-31' AND start_time < DATE '2001-07-30'
        GROUP BY pipeline_id""",
    "unowned_assets": """
        SELECT 'pipeline' AS asset_type, CAST(pipeline_id AS VARCHAR) AS asset_id FROM @pipelines WHERE owner_email IS NULL
        UNION ALL SELECT 'job', CAST(job_id AS VARCHAR) FROM @jobs WHERE owner_email IS NULL
        UNION ALL SELECT 'table', table_id FROM @tables WHERE owner_email IS NULL
        UNION ALL SELECT 'ml_model', CAST(model_id AS VARCHAR) FROM @models WHERE owner_email IS NULL
        UNION ALL SELECT 'ml_experiment', CAST(experiment_id AS VARCHAR) FROM @experiments WHERE owner_email IS NULL""",
    "unowned_prod_pipelines": """SELECT pipeline_id, pipeline_name FROM @pipelines
        WHERE is_production AND NOT has_owner_tag""",
    "owner_kind": f"""SELECT CASE WHEN owner_email IS NULL THEN 'none'
        WHEN owner_email IN (SELECT principal FROM @owner_groups) THEN 'group'
        WHEN regexp_matches(owner_email, {USER}) THEN 'user' ELSE 'service_principal' END AS owner_kind, count(*) AS n
        FROM @tables GROUP BY 1""",
    "individual_grants": f"""SELECT kind AS principal_kind, count(*) AS n,
        {_frac("count(*)", "(SELECT count(*) FROM @grants)", 4)} AS share
        FROM (SELECT CASE WHEN regexp_matches(principal, {USER}) THEN 'user' ELSE 'group' END AS kind FROM @grants) x
        GROUP BY kind""",
    "offending_grants": f"SELECT DISTINCT principal, object, privilege FROM @grants WHERE regexp_matches(principal, {USER})",
    "long_owned_by_creator": """SELECT table_id, CAST(DATE '2001-11-05' - created_at AS INTEGER) AS days_owned FROM @tables
        WHERE owner_email = created_by AND DATE '2001-11-05' - created_at > 180""",
    "ownership_coverage": f"""SELECT count(*) AS total, {_n("has_owner_tag")} AS owned,
        {_frac("100 * count(*) FILTER (WHERE has_owner_tag)", "count(*)", 2)} AS coverage_pct,
        round(95 - {_frac("100 * count(*) FILTER (WHERE has_owner_tag)", "count(*)", 2)}, 2) AS gap_pct
        FROM @pipelines WHERE is_production""",
    "ownership_trend": "SELECT * FROM #trend",
    "goal_forecast": """SELECT slope_per_day, current_pct, CASE WHEN slope_per_day > 0
          THEN CAST(greatest(0, ceil((95.0e0 - current_pct) / slope_per_day)) AS BIGINT) END AS days_to_goal
        FROM (SELECT round(regr_slope(coverage_pct, CAST(report_date - DATE '1970-01-01' AS DOUBLE)), 4) AS slope_per_day,
                     arg_max(coverage_pct, report_date) AS current_pct FROM #trend) x""",
    "ownership_trend_report": "SELECT report_date, coverage_pct, goal_pct FROM #trend",
    "production_ownership_split": """SELECT has_owner_tag AS has_owner, count(*) AS n FROM @pipelines WHERE is_production
        GROUP BY has_owner_tag""",
    "stale_experiments": """SELECT experiment_id, CAST(DATE '2001-08-02' - CAST(last_run_date AS DATE) AS INTEGER) AS days_since_run
        FROM @experiments_by_run WHERE DATE '2001-08-02' - CAST(last_run_date AS DATE) > 30""",
    "experiment_governance_gaps": """SELECT experiment_id, owner_email IS NULL AS no_owner,
        NOT has_description AS no_description, NOT has_registered_model AS no_model,
        CAST(owner_email IS NULL AS INT) + CAST(NOT has_description AS INT) + CAST(NOT has_registered_model AS INT) AS gaps
        FROM @experiments""",
    "stale_feature_models": "SELECT * FROM #stale_models",
    "stale_model_root_cause": """SELECT m.model_id, m.features_table, e.edit_count_90d AS edit_count,
        e.estimated_rerun_cost_usd AS rerun_cost_usd
        FROM #stale_models m LEFT JOIN #edits e ON e.table_id = m.features_table""",
    "unregistered_models": "SELECT model_id FROM @models WHERE NOT is_registered",
    "unused_models": "SELECT model_id FROM @models WHERE serving_endpoint_name IS NULL",
    "naming_violations": f"""SELECT data_layer, count(*) AS n, {_n(f"NOT regexp_matches(table_name, {NAME_OK})")} AS violations,
        {_frac(f"count(*) FILTER (WHERE NOT regexp_matches(table_name, {NAME_OK}))", "count(*)", 4)} AS rate
        FROM @tables GROUP BY data_layer""",
    "missing_comments": f"""SELECT data_layer, count(*) AS n, {_n("table_comment IS NULL")} AS missing,
        {_frac("count(*) FILTER (WHERE table_comment IS NULL)", "count(*)", 4)} AS rate
        FROM @tables GROUP BY data_layer""",
    "legacy_catalog_usage": f"""SELECT catalog_name, {_n("live")} AS active, {_n("NOT live")} AS idle
        FROM (SELECT catalog_name, table_id IN (SELECT table_id FROM @part_writes
                  WHERE event_time >= DATE '2001-08-07' AND event_time < DATE '2001-11-06') AS live FROM @tables
              WHERE catalog_name IN ('Brand#1', 'Brand#2', 'Brand#3')) x GROUP BY catalog_name""",
    "catalog_sprawl": """SELECT catalog_name, count(DISTINCT data_layer) AS layers, count(*) AS tables,
        NOT regexp_matches(catalog_name, '^(dev|test|staging|prod)(_[a-z0-9]+)*$') AS off_pattern
        FROM @tables GROUP BY catalog_name""",
    "lineage_coverage_gap": """SELECT t.table_id, count(e.node) AS edge_n FROM @tables t LEFT JOIN (
            SELECT source AS node FROM @edges UNION ALL SELECT target FROM @edges) e ON e.node = t.table_id
        WHERE t.table_id IN (SELECT table_id FROM @part_writes
            WHERE event_time >= DATE '2001-08-07' AND event_time < DATE '2001-11-06') GROUP BY t.table_id HAVING count(e.node) < 25""",
    "remediation_backlog": "SELECT * FROM #backlog",
    "backlog_ranked": f"""SELECT {_BRIEF}, row_number() OVER (
        ORDER BY {SEV_RANK}, business_impact_usd DESC, finding_id) AS rank FROM #backlog""",
    "backlog_top_n": f"""SELECT {_BRIEF} FROM #backlog WHERE severity IN ('critical', 'high')
        ORDER BY business_impact_usd DESC, finding_id LIMIT 10""",
    "top_anti_patterns": """SELECT finding_id, asset_name, business_impact_usd FROM #backlog WHERE severity = 'critical'
        ORDER BY business_impact_usd DESC, finding_id LIMIT 6""",
    "quick_wins": f"""SELECT {_BRIEF}, round(CAST(business_impact_usd AS DOUBLE) / sprint_estimate_days, 4) AS impact_per_day,
        row_number() OVER (ORDER BY sprint_estimate_days, business_impact_usd DESC, finding_id) AS rank FROM #backlog""",
    "backlog_filtered": f"""SELECT {_BRIEF}, {SEV_RANK} AS severity_rank FROM #backlog
        WHERE severity IN ('critical', 'medium')""",
    "severity_counts": f"""SELECT coalesce(category, 'overall') AS category, {_n("severity = 'critical'")} AS critical_n,
        {_n("severity = 'high'")} AS high_n, {_n("severity = 'medium'")} AS medium_n
        FROM #backlog GROUP BY GROUPING SETS ((category), ())""",
    "export_backlog": "SELECT * FROM #backlog",
    "health_scores": "SELECT * FROM #scores",
    "score_band": """SELECT *, CASE WHEN score < 60 THEN 'critical' WHEN score < 75 THEN 'warning' ELSE 'healthy' END AS band
        FROM #scores""",
    "score_delta_30d": """SELECT a.report_date, a.dimension, a.score, a.score - b.score AS score_delta_30d
        FROM #scores a LEFT JOIN #scores b ON b.dimension = a.dimension AND b.report_date = a.report_date - 30""",
    "worst_dimension": """SELECT dimension, score FROM #dimension_scores WHERE report_date = DATE '2001-08-02'
        ORDER BY score, dimension LIMIT 1""",
    "dimension_scores_now": """SELECT dimension, score, CASE WHEN score < 60 THEN 'critical' WHEN score < 75 THEN 'warning'
        ELSE 'healthy' END AS band FROM #scores WHERE report_date = DATE '2001-08-02'""",
    "score_trend": "SELECT report_date, dimension, score FROM #scores WHERE dimension = 'etl_hygiene'",
    "kpi_counters": f"""SELECT
        (SELECT score FROM #scores WHERE dimension = 'overall' AND report_date = DATE '2001-08-02') AS overall,
        {_n("severity = 'critical'")} AS critical_n, {_n("severity = 'high'")} AS high_n,
        {_n("severity = 'medium'")} AS medium_n,
        (SELECT count(*) FROM @pipelines WHERE NOT has_owner_tag) AS unowned_n FROM #backlog""",
    "gold_bronze_table_edits": """SELECT e.*, n.names AS downstream_gold_tables FROM #gold_edits e LEFT JOIN (
            SELECT table_id, string_agg(name, ',' ORDER BY name) AS names FROM (
                SELECT d.table_id, d.downstream_table, coalesce(min(t.table_name), d.downstream_table) AS name
                FROM #gold_dependents d JOIN @platform_tables t ON t.table_id = d.downstream_table AND t.data_layer = 'gold'
                GROUP BY d.table_id, d.downstream_table) x GROUP BY table_id) n ON n.table_id = e.table_id""",
    "gold_table_dependents": """SELECT d.table_id, d.downstream_table, count(*) OVER (PARTITION BY d.table_id) AS downstream_count
        FROM #gold_dependents d JOIN #gold_edits e ON e.table_id = d.table_id""",
    "gold_pipeline_health": "SELECT * FROM #health",
    "gold_ownership_trend": "SELECT * FROM #gold_trend",
    "gold_remediation_backlog": "SELECT * FROM #gold_backlog",
    "gold_health_scores": f"""SELECT a.report_date, a.dimension, a.score, a.score - b.score AS score_delta_30d,
            coalesce(c.critical_n, 0) AS critical_count, coalesce(c.high_n, 0) AS high_count, coalesce(c.medium_n, 0) AS medium_count
        FROM #gold_scores a LEFT JOIN #gold_scores b ON b.dimension = a.dimension AND b.report_date = a.report_date - 30
        LEFT JOIN (SELECT CASE category WHEN 'ETL Hygiene' THEN 'etl_hygiene' WHEN 'ML/AI Governance' THEN 'ml_ai_governance'
                WHEN 'Ownership & Access' THEN 'ownership_access' WHEN 'Data Quality' THEN 'data_quality' ELSE 'overall' END AS dim,
                {_n("severity = 'critical'")} AS critical_n, {_n("severity = 'high'")} AS high_n, {_n("severity = 'medium'")} AS medium_n
            FROM #gold_backlog GROUP BY GROUPING SETS ((category), ())) c ON c.dim = a.dimension""",
    "watermark_extract": """SELECT * FROM @events e WHERE ts >= (SELECT max(ts) FROM @events WHERE ts < DATE '2024-01-20')
        AND ts >= DATE '2024-01-20'""",
    "idempotent_append": "SELECT * FROM @events",
    "idempotent_append_indexed": "SELECT * FROM @events",
    "upsert_scd1": """SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM @feed) x WHERE rn = 1 AND op <> 'DELETE'""",
    "scd2_history": """SELECT user_id, value, ts AS valid_from, valid_to, valid_to IS NULL AS is_current FROM (
        SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM (
            SELECT *, lag(op) OVER w AS pop, lag(value) OVER w AS pvalue FROM @feed
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) s
        WHERE CASE WHEN op = 'DELETE' THEN coalesce(pop <> 'DELETE', false)
                   ELSE pop IS NULL OR pop = 'DELETE' OR value IS DISTINCT FROM pvalue END) k
        WHERE op <> 'DELETE'""",
    "snapshot_diff": """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
        CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
        o.c_acctbal AS old_value, n.c_acctbal AS new_value
        FROM @snap_old o FULL JOIN @snap_new n ON o.c_custkey = n.c_custkey
        WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal IS DISTINCT FROM n.c_acctbal""",
    "snapshot_diff_stored": """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
        CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
        o.c_acctbal AS old_value, n.c_acctbal AS new_value
        FROM @snap_old o FULL JOIN @snap_new n ON o.c_custkey = n.c_custkey
        WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal IS DISTINCT FROM n.c_acctbal""",
    "full_reconcile": """SELECT CASE WHEN n.c_custkey IS NULL THEN 'only_a' WHEN o.c_custkey IS NULL THEN 'only_b'
        WHEN o.c_acctbal IS NOT DISTINCT FROM n.c_acctbal THEN 'same' ELSE 'changed' END AS side, count(*) AS n
        FROM @snap_old o FULL JOIN @snap_new n ON o.c_custkey = n.c_custkey GROUP BY 1""",
    "full_reconcile_stored": """SELECT CASE WHEN n.c_custkey IS NULL THEN 'only_a' WHEN o.c_custkey IS NULL THEN 'only_b'
        WHEN o.c_acctbal IS NOT DISTINCT FROM n.c_acctbal THEN 'same' ELSE 'changed' END AS side, count(*) AS n
        FROM @snap_old o FULL JOIN @snap_new n ON o.c_custkey = n.c_custkey GROUP BY 1""",
    "multiset_reconcile": """SELECT 'only_a' AS side, count(*) AS n FROM (
            SELECT * FROM @snap_old EXCEPT ALL SELECT * FROM @snap_new) a
        UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM @snap_new EXCEPT ALL SELECT * FROM @snap_old) b""",
    "soft_delete_apply": "SELECT * FROM @snap_old WHERE c_custkey NOT IN (SELECT c_custkey FROM @snap_new)",
    "schema_policy_add_new": f"""SELECT event_id, ts, user_id, event_type, try_cast(value AS DOUBLE) AS value, props,
        CASE WHEN {_BAD_VALUE} THEN concat('{{"value":"', value, '"}}') END AS _rescued_data FROM @drifted""",
    "schema_policy_add_new_widen": f"""SELECT event_id, ts, user_id, event_type, try_cast(value AS DOUBLE) AS value, props,
        CASE WHEN {_BAD_VALUE} THEN concat('{{"value":"', value, '"}}') END AS _rescued_data FROM @drifted""",
    "schema_policy_rescue": f"""SELECT event_id, ts, user_id, event_type, try_cast(value AS DOUBLE) AS value,
        {_RESCUE} AS _rescued_data FROM @drifted""",
    "schema_policy_none": """SELECT event_id, ts, user_id, event_type, try_cast(value AS DOUBLE) AS value FROM @drifted""",
    "schema_policy_fail_on_new": """SELECT 'new columns [''props''], changed types [''value'']' AS message,
        count(*) AS refused_n FROM @drifted""",
    "rescued_data": f"""SELECT event_id, ts, user_id, event_type, try_cast(value AS DOUBLE) AS value,
        {_RESCUE} AS _rescued_data FROM @drifted""",
    "schema_drift": f"""
        SELECT 'value' AS "column", 'retyped' AS change, 'double' AS old_type, 'string' AS new_type
        WHERE (SELECT count(*) FROM @drifted WHERE {_BAD_VALUE}) > 0
          AND (SELECT count(*) FROM @undrifted WHERE {_BAD_VALUE}) = 0
        UNION ALL
        SELECT 'props', 'added', NULL, CASE WHEN count(*) FILTER (WHERE try_cast(props AS DOUBLE) IS NULL) > 0
               THEN 'string' ELSE 'double' END FROM @drifted""",
    "expectations": " UNION ALL ".join(
        f"SELECT '{n}' AS rule, {_n(r)} AS passed, {_n(f'NOT coalesce({r}, false)')} AS failed FROM @runs"
        for n, r in _FAILED_RULES.items()
    ),
    "expectations_drop": f"SELECT run_id, status FROM @runs WHERE {' AND '.join(_FAILED_RULES.values())}",
    "quarantine": f"""SELECT * FROM (SELECT run_id, concat_ws(',', {", ".join(
        f"CASE WHEN NOT ({r}) THEN '{n}' END" for n, r in _FAILED_RULES.items())}) AS failed_rules FROM @runs) x
        WHERE failed_rules <> ''""",
    "not_null_unique_check": """
        SELECT 'null_key' AS "check", count(*) AS bad_n FROM @lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL
        UNION ALL
        SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM @lineitem GROUP BY l_orderkey, l_linenumber
               HAVING count(*) > 1) x""",
    "fk_check": """SELECT 'orphan_reference' AS "check", count(*) AS bad_n FROM @orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM @snap_new)""",
    "interval_check": """SELECT 'end_before_start' AS "check", count(*) AS bad_n FROM @timed_runs
        WHERE end_time < start_time""",
    "freshness_check": """SELECT table_name, max(event_time) AS max_ts, CAST(DATE '2024-01-31' - CAST(max(event_time) AS DATE) AS INTEGER) AS age_days,
        count(*) AS n, DATE '2024-01-31' - CAST(max(event_time) AS DATE) <= 2 AND count(*) >= 100 AS ok FROM @writes
        GROUP BY table_name""",
    "row_count_anomaly": """SELECT table_name, day, n, z, coalesce(abs(z) > 2, false) AS anomaly FROM (
        SELECT table_name, day, n, round((d - avg(d) OVER w) / nullif(stddev_samp(d) OVER w, 0), 4) AS z FROM (
            SELECT table_name, day, n, CAST(n - lag(n) OVER (PARTITION BY table_name ORDER BY day) AS DOUBLE) AS d FROM (
                SELECT table_name, CAST(event_time AS DATE) AS day, count(*) AS n FROM @writes GROUP BY 1, 2) a) b
        WINDOW w AS (PARTITION BY table_name ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) c""",
    "retention_archive": """SELECT CAST(strftime(ts, '%Y%m') AS INT) AS month, count(*) AS archived_n FROM @events
        WHERE ts < DATE '2024-01-24' GROUP BY 1""",
    "column_stats": " UNION ALL ".join(
        _stats(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    ),
    "sensitive_name_scan": f"""SELECT object, column_name FROM @columns c
        WHERE regexp_matches(column_name, '{SENSITIVE_NAME}') AND NOT EXISTS (
            SELECT 1 FROM @column_tags t WHERE t.object = c.object AND t.column_name = c.column_name)""",
    "content_classify": " UNION ALL ".join(_checked_hits(o, c, r) for o, c in (("documents", "text"), ("pages", "html"), ("conversations", "text")) for r in _CLASSES),
    "custom_classifiers": " UNION ALL ".join(
        f"""SELECT '{n}' AS rule, {_n(f"regexp_matches(text, '{p}')")} AS hits,
            {_frac(f"count(*) FILTER (WHERE regexp_matches(text, '{p}'))", "count(text)", 6)} AS hit_rate FROM @documents"""
        for n, p in _OWN_RULES.items()
    ),
    "auto_tag": """SELECT object, column_name, concat('class.', rule) AS tag FROM #classified WHERE hit_rate >= 0.005
        AND NOT (object = 'documents' AND rule = 'email_address')""",
    "tag_inheritance": """SELECT object, tag_key, tag_value, from_level FROM (
        SELECT o.object, t.tag_key, t.tag_value, t.level AS from_level, row_number() OVER (
            PARTITION BY o.object, t.tag_key
            ORDER BY CASE t.level WHEN 'table' THEN 0 WHEN 'schema' THEN 1 ELSE 2 END) AS rn
        FROM @objects o JOIN @object_tags t ON t.object = CASE t.level WHEN 'table' THEN o.object
            WHEN 'schema' THEN o.schema_object ELSE o.catalog_object END) x WHERE rn = 1""",
    "column_mask": _masked("@documents", "doc_id", "text"),
    "row_filter": """SELECT * FROM @customers_by_nation WHERE n_name IN (
        SELECT object FROM @grants WHERE privilege = 'SELECT' AND principal LIKE 'grp_%')""",
    "unprotected_tables": f"""SELECT DISTINCT object FROM @columns
        WHERE regexp_matches(column_name, '{SENSITIVE_NAME}') AND object NOT IN (SELECT object FROM @policies)""",
    "classification_vs_ownership": f"""SELECT c.schema_name, c.untagged_rate, t.unowned_rate FROM (
        SELECT schema_name, {_frac("count(*) FILTER (WHERE g.object IS NULL)", "count(*)", 4)} AS untagged_rate
        FROM @columns k LEFT JOIN @column_tags g ON g.object = k.object AND g.column_name = k.column_name
        WHERE regexp_matches(k.column_name, '{SENSITIVE_NAME}') GROUP BY schema_name) c JOIN (
        SELECT catalog_name, {_frac("count(*) FILTER (WHERE owner_email IS NULL)", "count(*)", 4)} AS unowned_rate
        FROM @tables GROUP BY catalog_name) t ON t.catalog_name = c.schema_name""",
    "snippet_sanitize": """SELECT doc_id, substring(regexp_replace(regexp_replace(text, '''[^'']*''', '?', 'g'),
        '[0-9]+', '?', 'g'), 1, 120) AS snippet FROM @documents""",
    "small_files": """SELECT table_id, round(CAST(size_bytes AS DOUBLE) / num_files / 1048576.0e0, 2) AS avg_mb
        FROM @table_detail WHERE CAST(size_bytes AS DOUBLE) / num_files / 1048576.0e0 < 100""",
    "over_partitioned": f"""SELECT table_id, round(CAST(size_bytes AS DOUBLE) / num_partitions / 1048576.0e0, 2)
            AS mb_per_partition,
        CASE WHEN size_bytes < {TB1} THEN CASE WHEN partition_column = 'event_date' THEN 'small table by date'
             ELSE 'small table' END
             ELSE CASE WHEN partition_column = 'event_date' THEN 'thin date partitions' ELSE 'thin partitions' END END AS reason
        FROM @table_detail WHERE partition_column IS NOT NULL
          AND (size_bytes < {TB1} OR CAST(size_bytes AS DOUBLE) / num_partitions < {GB1})""",
    "layout_advice": f"""SELECT table_id, CASE WHEN size_bytes < {TB1} THEN 'none' WHEN size_bytes < 100 * {TB1} THEN 'cluster'
        WHEN num_partitions <= 1000 THEN 'partition' ELSE 'cluster' END AS advice FROM @table_detail""",
    "stale_stats": """SELECT * FROM (
        SELECT h.table_id, 'stale_stats' AS flag,
               CASE WHEN o.analyzed IS NULL THEN 'never analyzed' ELSE 'changed after analysis' END AS reason,
               round(CAST(sum(CASE WHEN operation = 'WRITE' AND (o.analyzed IS NULL OR op_date > o.analyzed) THEN rows_changed
                              ELSE 0 END) AS DOUBLE) / max(d.num_rows), 4) AS changed_ratio
        FROM @table_history h JOIN #last_ops o ON o.table_id = h.table_id JOIN @table_detail d ON d.table_id = h.table_id
        GROUP BY h.table_id, o.analyzed) x WHERE reason = 'never analyzed' OR changed_ratio >= 0.1""",
    "layout_columns": """SELECT "column", ndv, CASE WHEN ndv <= 1 THEN 'none'
            WHEN ndv <= 1000 AND n / ndv >= 100 THEN 'partition' ELSE 'cluster' END AS role FROM (
        SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS ndv, count(*) AS n FROM @orders
        UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM @orders
        UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(*) FROM @orders
        UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey), count(*) FROM @orders) x""",
    "small_files_measured": "SELECT count(*) AS rows, true AS measured FROM @lineitem",
    "compact": "SELECT * FROM @events",
    "cluster_layout": "SELECT * FROM @events",
    "vacuum_policy": """
        SELECT table_id, 'vacuum' AS flag, CASE WHEN vacuumed IS NULL THEN 'never vacuumed' ELSE 'not vacuumed lately' END
            AS reason FROM #last_ops WHERE vacuumed IS NULL OR DATE '2001-11-05' - vacuumed > 30
        UNION ALL
        SELECT table_id, 'retention', 'retention under seven days' FROM @table_properties WHERE retention_days < 7""",
    "purge_before_vacuum": """SELECT table_id, 'purge_order' AS flag,
        CASE WHEN purged IS NULL THEN 'never purged' ELSE 'purged after vacuum' END AS reason FROM #last_ops
        WHERE vacuumed IS NOT NULL AND (purged IS NULL OR purged > vacuumed)""",
    "maintenance_coverage": """SELECT table_id, 'uncovered' AS flag, 'not a managed table' AS reason FROM @table_detail
        WHERE NOT is_managed""",
    "stream_ingest": "SELECT * FROM @events",
    "incremental_files": "SELECT * FROM @events WHERE ts >= DATE '2024-01-16'",
    "stream_dedup": "SELECT event_id, event_time FROM @writes",
    "stream_direct_write_alerts": f"""SELECT CAST(event_time AS DATE) AS day, table_name, count(*) AS n FROM @writes
        WHERE {DIRECT} GROUP BY ALL""",
    "stream_edit_sessions": """SELECT user_email, min(event_time) AS started, max(event_time) + INTERVAL '30' MINUTE AS ended,
        count(*) AS edits FROM (
            SELECT *, sum(opens) OVER (PARTITION BY user_email ORDER BY event_time) AS s FROM (
                SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY user_email ORDER BY event_time)
                       < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM @writes) a) b
        GROUP BY user_email, s""",
    "stream_expectations": "SELECT event_id, value FROM @events WHERE value > 1 AND value < 60",
    "stream_cdc_apply": """SELECT user_id, ts AS event_time, event_id, value FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM @feed) x WHERE rn = 1 AND op <> 'DELETE'""",
    "late_data_policy": """SELECT status, count(*) AS n FROM (SELECT CASE WHEN (ts >= DATE '2024-01-22' OR event_id % 100 = 0)
            AND ts < (SELECT max(ts) - INTERVAL '1' DAY FROM @events WHERE ts < DATE '2024-01-22' AND event_id % 100 <> 0)
            THEN 'late' ELSE 'on_time' END AS status FROM @events) x GROUP BY status""",
}

_WALK = """walk(source, target, depth) AS (
    SELECT source, target, 1 FROM in_edges
    UNION ALL
    SELECT w.source, e.target, w.depth + 1 FROM walk w JOIN in_edges e ON e.source = w.target)"""
_REF = re.compile(r"([@#])([a-z_0-9]+)")


def _needed(body: str, seen: dict[str, str]) -> None:
    for mark, name in _REF.findall(body):
        key = ("in_" if mark == "@" else "step_") + name
        if key in seen:
            continue
        if mark == "@":
            seen[key] = as_sql(name)
        elif name in STEPS:
            _needed(STEPS[name], seen)
            seen[key] = _plain(STEPS[name])


def _plain(body: str) -> str:
    return _REF.sub(lambda m: ("in_" if m[1] == "@" else "step_") + m[2] if m[1] == "@" or m[2] in STEPS else m[0], body)


STEPS |= {f"query_{name}": body for name, body in ORACLE.items()}

STEPS["ledger_days"] = "SELECT * FROM (VALUES (1, DATE '2001-05-01'), (2, DATE '2001-06-15'), (3, DATE '2001-08-01')) v(k, day)"
STEPS["ledger_hits"] = f"""SELECT DISTINCT table_id, k, day FROM @part_writes, #ledger_days
    WHERE {DIRECT} AND event_time >= day - 20 AND event_time < day + 1"""
STEPS["ledger_spans"] = """SELECT table_id, min(day) AS first_seen, max(day) AS last_seen, max(k) AS last, min(k) AS first, count(*) AS n
    FROM #ledger_hits GROUP BY table_id"""
ORACLE["findings_ledger"] = """
    SELECT concat('FND-', md5(concat('ETL Hygiene|table|direct_writes|', table_id))) AS finding_id, table_id AS asset_name, first_seen, last_seen,
           (SELECT day FROM #ledger_days WHERE k = f.last + 1) AS resolved_at, CAST(f.last - f.first + 1 - n AS INTEGER) AS reopened,
           CASE WHEN last < 3 THEN 'resolved' WHEN last - first + 1 > n THEN 'reopened' ELSE 'open' END AS status FROM #ledger_spans f"""

#: The closure, and the closure after edges were added to a part of them.
WALKS = ("lineage_closure", "lineage_closure_delta")
ORACLE["lineage_closure_delta"] = ORACLE["lineage_closure"]


def statement(name: str) -> str:
    """One self-contained statement for a registered query."""
    body = ORACLE[name]
    parts: dict[str, str] = {}
    if name in WALKS:
        body_refs = body + " @edges"
    else:
        body_refs = body
    _needed(body_refs, parts)
    ctes = [f"{k} AS ({v})" for k, v in parts.items()]
    if name in WALKS:
        ctes.append(_WALK)
    return f"WITH {'RECURSIVE ' if name in WALKS else ''}{', '.join(ctes)} {_plain(body)}"
