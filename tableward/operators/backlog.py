"""The remediation backlog: every detector's findings in one shape, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import breaks_naming, col, day_literal, has_value, is_false, is_true, severity_rank
from tableward.functions.skew import with_position
from tableward.session import keep

_COLUMNS = [f.name for f in model.FINDING_SCHEMA.fields]


def finding(
    df: DataFrame,
    rule: str,
    severity: str | Column,
    category: str,
    asset_type: str,
    asset: str | Column,
    description: str | Column,
    action: str,
    days: int,
    detected_at: Column,
    impact: Column | float = 0.0,
    owner: Column | None = None,
    label: str | None = None,
) -> DataFrame:
    """Project one detector's rows to the finding columns.

    The id is a digest of rule and asset: it is the same in every run and needs no numbering of all rows.
    ``label`` names the asset for readers where ``asset`` is only its key.
    """

    def text(value):
        return value if isinstance(value, Column) else F.lit(value)

    name = col(asset).cast("string")
    key = F.concat_ws("|", F.lit(category), F.lit(asset_type), F.lit(rule), name)
    amount = impact if isinstance(impact, Column) else F.lit(impact)
    return df.select(
        F.concat(F.lit("FND-"), F.md5(key)).alias("finding_id"),
        text(severity).alias("severity"),
        F.lit(category).alias("category"),
        F.lit(asset_type).alias("asset_type"),
        (name if label is None else F.coalesce(label, name)).alias("asset_name"),
        (owner if owner is not None else F.lit(None)).cast("string").alias("owner_email"),
        text(description).alias("description"),
        amount.cast("decimal(18,2)").alias("business_impact_usd"),
        F.lit(action).alias("recommended_action"),
        detected_at.cast("date").alias("detected_at"),
        F.lit(days).alias("sprint_estimate_days"),
    )


def edit_findings(edits: DataFrame, first_seen: DataFrame, label: str | None = None) -> DataFrame:
    return finding(
        edits.join(first_seen, "table_id", "left"),
        "direct_writes", F.col("severity"), "ETL Hygiene", "table", "table_id",
        F.concat(F.col("edit_count_90d").cast("string"), F.lit(" direct writes in the window")),
        "Take away direct write rights and route changes through a pipeline", 3,
        F.col("detected_at"), F.col("estimated_rerun_cost_usd"), label=label,
    )


def rule_findings(df: DataFrame, asset_type: str, asset: str, rules: list[tuple], as_of, label: str | None = None) -> DataFrame:
    """All rules over one kind of asset in one pass: each row is expanded to the rules it breaks.

    A rule is (condition, name, severity, category, description, action, days, impact).
    """
    broken = F.array_compact(
        F.array(
            *[
                F.when(
                    hit,
                    F.struct(
                        F.lit(rule).alias("rule"),
                        F.lit(sev).alias("severity"),
                        F.lit(category).alias("category"),
                        F.lit(text).alias("description"),
                        F.lit(action).alias("action"),
                        F.lit(days).alias("days"),
                        F.lit(float(impact)).alias("impact"),
                    ),
                )
                for hit, rule, sev, category, text, action, days, impact in rules
            ]
        )
    )
    name = F.col(asset).cast("string")
    shown = name if label is None else F.coalesce(label, name)
    hits = df.select(name.alias("_id"), shown.alias("asset_name"), "owner_email", F.explode(broken).alias("f"))
    key = F.concat_ws("|", "f.category", F.lit(asset_type), "f.rule", "_id")
    return hits.select(
        F.concat(F.lit("FND-"), F.md5(key)).alias("finding_id"),
        "f.severity",
        "f.category",
        F.lit(asset_type).alias("asset_type"),
        "asset_name",
        "owner_email",
        "f.description",
        F.col("f.impact").cast("decimal(18,2)").alias("business_impact_usd"),
        F.col("f.action").alias("recommended_action"),
        day_literal(as_of).alias("detected_at"),
        F.col("f.days").alias("sprint_estimate_days"),
    )


def pipeline_findings(health: DataFrame, as_of, impact: float = 1000.0, label: str | None = None) -> DataFrame:
    rules = [
        (F.col("failure_rate_30d") > model.FAILURE_CRITICAL, "failing", "critical", "ETL Hygiene",
         "Failure rate above the critical limit", "Fix the failing step and add alerting", 3, 4 * impact),
        (is_false("has_owner_tag") & is_true("is_production"), "unowned", "high", "Ownership & Access",
         "Production pipeline has no owner", "Assign an owner", 2, 2 * impact),
        (is_false("has_dq_expectations"), "no_dq", "high", "ETL Hygiene",
         "Pipeline has no data-quality rules", "Add expectations", 3, impact),
        (is_true("uses_hardcoded_paths"), "paths", "high", "ETL Hygiene",
         "Pipeline uses hard-coded paths", "Move paths to parameters", 3, impact),
    ]
    return rule_findings(health, "pipeline", "pipeline_id", rules, as_of, label)


def model_findings(models: DataFrame, stale: DataFrame, as_of, label: str | None = None) -> DataFrame:
    on_raw = finding(
        stale, "stale_features", "critical", "ML/AI Governance", "ml_model", "model_id",
        "Model reads features from a raw table that was edited by hand", "Retrain on silver features", 5,
        F.col("last_write"), 5000.0, label=label,
    )
    rules = [
        (is_false("is_registered"), "unregistered", "high", "ML/AI Governance", "Model is not in the registry",
         "Register the model", 4, 800),
    ]
    return on_raw.unionByName(rule_findings(models, "ml_model", "model_id", rules, as_of, label))


def table_findings(tables: DataFrame, as_of, label: str | None = None) -> DataFrame:
    rules = [
        (breaks_naming("table_name"), "naming", "medium", "Data Quality", "Table name breaks the naming rule",
         "Give the table a name of layer, domain and entity", 1, 100),
        ((F.col("data_layer") == "bronze") & ~has_value("table_comment"), "comment", "medium", "Data Quality",
         "Bronze table has no comment", "Describe the table", 1, 50),
        (~has_value("owner_email"), "unowned", "medium", "Ownership & Access", "Table has no owner", "Assign an owner", 1, 200),
    ]
    return rule_findings(tables, "table", "table_id", rules, as_of, label)


def experiment_findings(stale: DataFrame, as_of, label: str | None = None) -> DataFrame:
    return finding(
        stale, "stale_experiment", "high", "ML/AI Governance", "ml_experiment", "experiment_id",
        "Experiment has not run lately", "Archive or rerun the experiment", 2, day_literal(as_of), 300.0,
        label=label,
    )


def experiment_rule_findings(experiments: DataFrame, as_of, label: str | None = None) -> DataFrame:
    rules = [
        (~has_value("owner_email"), "unowned", "medium", "Ownership & Access", "Experiment has no owner", "Assign an owner", 1, 100),
        (is_false("has_description"), "no_description", "medium", "ML/AI Governance", "Experiment is not described",
         "Describe the experiment", 1, 50),
        (is_false("has_registered_model"), "no_model", "medium", "ML/AI Governance", "Experiment has no registered model",
         "Register its model or archive it", 2, 150),
    ]
    return rule_findings(experiments, "ml_experiment", "experiment_id", rules, as_of, label)


def column_findings(untagged: DataFrame, as_of) -> DataFrame:
    """``untagged`` is ``governance.sensitive_name_scan``."""
    return finding(
        untagged, "untagged", "high", "Ownership & Access", "table", F.concat_ws(".", "object", "column_name"),
        "Column with a telling name has no class tag", "Tag the column and protect it", 1, day_literal(as_of), 750.0,
    )


def layout_findings(small: DataFrame, as_of) -> DataFrame:
    """``small`` is ``layout.small_files``."""
    return finding(
        small, "small_files", "medium", "ETL Hygiene", "table", "table_id", "Files are small on average",
        "Compact the table", 1, day_literal(as_of), 150.0,
    )


def run_findings(weekly: DataFrame, as_of, weeks: int = 3) -> DataFrame:
    """``weekly`` is ``runs.weekly_failures``."""
    return finding(
        weekly.filter(F.col("weeks_with_failure") >= weeks), "weekly", "high", "ETL Hygiene", "pipeline", "pipeline_id",
        "Pipeline fails week after week", "Find the recurring cause", 3, day_literal(as_of), 1500.0,
    )


#: Our own estimates for detectors whose rows are findings as they are: (name of the detector, condition, rule, asset type, asset, severity, category,
#: description, action, days, impact).
DETECTORS: list[tuple] = [
    ("legacy_catalog_usage", None, "legacy_catalog", "table", ("catalog_name",), "medium", "Data Quality",
     "Catalog is a legacy one", "Move its tables to a governed catalog", 5, 400.0),
    ("catalog_sprawl", "off_pattern", "catalog_name", "table", ("catalog_name",), "medium", "Data Quality",
     "Catalog name follows no environment pattern", "Rename or merge the catalog", 2, 100.0),
    ("lineage_coverage_gap", None, "lineage_gap", "table", ("table_id",), "medium", "Data Quality",
     "Table is written to but hardly appears in lineage", "Write it through tracked pipelines", 2, 150.0),
    ("offending_grants", None, "user_grant", "table", ("principal", "object", "privilege"), "high", "Ownership & Access",
     "Grant is held by a named user", "Grant it to a group", 1, 200.0),
    ("long_owned_by_creator", None, "creator_owned", "table", ("table_id",), "medium", "Ownership & Access",
     "Table still belongs to whoever created it", "Hand it over to a group", 1, 100.0),
    ("unused_models", None, "unused_model", "ml_model", ("model_id",), "medium", "ML/AI Governance",
     "Model is served nowhere", "Serve the model or retire it", 1, 300.0),
    ("full_rescan_signal", "slope > 0 AND row_slope > 0 AND row_r2 >= 0.5", "full_rescan", "pipeline", ("pipeline_id",), "high", "ETL Hygiene",
     "Runs take longer with every row of the target", "Load only what is new", 5, 1200.0),
    ("retry_after_failure", None, "retries", "pipeline", ("pipeline_id",), "medium", "ETL Hygiene",
     "Pipeline was run again after failed or cancelled runs", "Make loads idempotent and watch retries", 2, 500.0),
    ("duplicate_load_signal", None, "duplicate_load", "pipeline", ("pipeline_id",), "high", "ETL Hygiene",
     "A retry grew the target by more than an ordinary run", "Check for rows loaded twice", 3, 1500.0),
    ("external_db_ingest", None, "external_database", "pipeline", ("pipeline_id",), "medium", "ETL Hygiene",
     "Pipeline reads straight from an external database", "Use a managed connector or change feed", 5, 600.0),
    ("over_partitioned", None, "over_partitioned", "table", ("table_id",), "medium", "ETL Hygiene",
     "Table has more partitions than its size warrants", "Cluster the table instead", 3, 250.0),
    ("stale_stats", None, "stale_stats", "table", ("table_id",), "medium", "ETL Hygiene",
     "Statistics are missing or out of date", "Analyze the table", 1, 100.0),
    ("vacuum_policy", "flag = 'vacuum'", "vacuum", "table", ("table_id",), "medium", "ETL Hygiene",
     "Table has not been vacuumed lately", "Vacuum the table on a schedule", 1, 80.0),
    ("vacuum_policy", "flag = 'retention'", "retention", "table", ("table_id",), "high", "ETL Hygiene",
     "Deleted files are kept for less than seven days", "Raise the retention to seven days or more", 1, 300.0),
    ("purge_before_vacuum", None, "purge_order", "table", ("table_id",), "high", "Ownership & Access",
     "Soft deletes were not purged before the last vacuum", "Purge, then vacuum", 1, 350.0),
    ("maintenance_coverage", None, "unmaintained", "table", ("table_id",), "medium", "ETL Hygiene",
     "Table is outside automatic upkeep", "Make it a managed table", 2, 120.0),
    ("unprotected_tables", None, "unprotected", "table", ("object",), "critical", "Ownership & Access",
     "Table with telling columns has no policy", "Mask its columns or filter its rows", 2, 2500.0),
]


def detector_findings(found: dict[str, DataFrame], as_of) -> list[DataFrame]:
    """Findings of the detectors whose results are given, by name (``DETECTORS``); an asset is found once by each rule."""
    if unknown := set(found) - {d[0] for d in DETECTORS}:
        raise ValueError(f"no such detectors: {sorted(unknown)}")
    out = []
    for name, condition, rule, asset_type, asset, severity, category, text, action, days, impact in DETECTORS:
        if name in found:
            hits = found[name] if condition is None else found[name].filter(condition)
            key = F.concat_ws("|", *(F.col(c).cast("string") for c in asset))
            hits = hits.select(key.alias("_asset")).distinct()
            out.append(finding(hits, rule, severity, category, asset_type, "_asset", text, action, days, day_literal(as_of), impact))
    return out


def job_findings(jobs: DataFrame, as_of, managed: str = "serverless", saving: float = 0.4, label: str | None = None) -> DataFrame:
    classic = jobs.filter(~F.col("cluster_type").eqNullSafe(managed))
    unowned = [(~has_value("owner_email"), "unowned", "high", "Ownership & Access", "Job has no owner", "Assign an owner", 2, 500)]
    return rule_findings(jobs, "job", "job_id", unowned, as_of, label).unionByName(_classic(classic, as_of, saving, label))


def _classic(classic: DataFrame, as_of, saving: float, label: str | None) -> DataFrame:
    return finding(
        classic, "classic_compute", "medium", "ETL Hygiene", "job", "job_id", "Job runs on self-managed compute",
        "Move the job to managed compute", 2, day_literal(as_of),
        F.round(F.col("annual_cost_usd").cast("double") * saving, 2), label=label,
    )


def remediation_backlog(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*_COLUMNS) for f in findings])


def ranked(backlog: DataFrame) -> DataFrame:
    """Severity first, then impact, then id; ``rank`` numbers all rows, which come in no set order.

    A range sort looks at its input twice, so the findings are written down once before it.
    """
    placed = with_position(
        keep(backlog, "backlog").withColumn("_sev", severity_rank()), [F.asc("_sev"), F.desc("business_impact_usd"), F.asc("finding_id")]
    )
    return placed.drop("_sev")


def top_n(backlog: DataFrame, n: int = 10, severities: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    return (
        backlog.filter(F.col("severity").isin(*severities))
        .orderBy(F.desc("business_impact_usd"), "finding_id")
        .limit(n)
    )


def top_anti_patterns(backlog: DataFrame, n: int = 6) -> DataFrame:
    return top_n(backlog, n, ("critical",))


def quick_wins(backlog: DataFrame) -> DataFrame:
    """Least effort first, then highest impact."""
    per_day = F.round(F.col("business_impact_usd").cast("double") / F.col("sprint_estimate_days"), 4)
    placed = with_position(
        keep(backlog, "backlog").withColumn("impact_per_day", per_day),
        [F.asc("sprint_estimate_days"), F.desc("business_impact_usd"), F.asc("finding_id")],
    )
    return placed


def filtered(backlog: DataFrame, severities: list[str]) -> DataFrame:
    return (
        backlog.filter(F.col("severity").isin(*severities))
        .withColumn("severity_rank", severity_rank())
        .orderBy("severity_rank", F.desc("business_impact_usd"), "finding_id")
    )


def severity_counts(backlog: DataFrame) -> DataFrame:
    """Counts per category and overall, from one pass."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_n") for s in model.SEVERITIES]
    return (
        backlog.rollup("category")
        .agg(*counts)
        .withColumn("category", F.coalesce("category", F.lit("overall")))
    )
