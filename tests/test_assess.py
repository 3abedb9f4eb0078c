"""The whole assessment on a small platform written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableward import model
from tableward.operators import lineage
from tableward.operators.backlog import finding
from tableward.plans.assess import assess
from tableward.sources.files import described, publish_views

AS_OF = "2024-06-30"


def at(days, hour=0):
    return dt.datetime(2024, 6, 30, hour) - dt.timedelta(days=days)


@pytest.fixture(scope="module")
def raw(spark):
    old = at(300)
    rows = {
        "raw_ws_tables": [
            ("b1", "bronze_sales_orders", "main", "sales", "bronze", "a@x.org", True, None, False, 1, old, old),
            ("b2", "Orders", "main", "sales", "bronze", None, False, "raw", True, 1, old, old),
            ("b3", "bronze_sales_orders", "lab", "sales", "bronze", "a@x.org", True, "copy", False, 1, old, old),
            ("s1", "silver_sales_orders", "main", "sales", "silver", "a@x.org", True, "s", False, 1, old, old),
            ("g1", "gold_sales_daily", "main", "sales", "gold", "a@x.org", True, "g", False, 1, old, old),
            ("g2", "gold_sales_weekly", "main", "sales", "gold", "a@x.org", True, "g", False, 1, old, old),
        ],
        "raw_ws_pipelines": [
            ("p1", "daily", "a@x.org", True, True, "cron", True, False, "ok", dt.date(2024, 6, 29), 60, old),
            ("p2", "weekly", None, False, True, "cron", None, True, "ok", dt.date(2024, 6, 29), 60, old),
            ("p3", "lab", None, None, False, "cron", True, None, "ok", dt.date(2024, 6, 29), 60, old),
        ],
        "raw_ws_jobs": [("j1", "load", "a@x.org", True, "* * *", "serverless", old), ("j2", "dump", None, False, "* * *", "classic", old)],
        "raw_ws_job_runs": [(f"r{k}", "j1", "p1", at(k, 3), at(k, 4), "failed" if k % 2 else "succeeded", 3600, "cron") for k in range(10)],
        "raw_ws_audit_events": [(f"e{k}", at(k, 10), "u@x.org", "UPDATE", "b1", "bronze_sales_orders", "bronze", 1, "") for k in range(4)]
        + [("e9", at(200), "u@x.org", "UPDATE", "b2", "Orders", "bronze", 1, ""), ("e10", at(1), "u@x.org", "UPDATE", "g1", "gold_sales_daily", "gold", 1, "")],
        "raw_ws_ml_experiments": [("x1", "tried", None, "/a", None, True, False, None, old), ("x2", "used", "a@x.org", "/b", dt.date(2024, 6, 20), False, True, True, old)],
        "raw_ws_ml_models": [
            ("m1", "risk", "ep", "main.sales.bronze_sales_orders", "bronze", None, None, True, "a@x.org", True),
            ("m2", "churn", None, "lab.sales.bronze_sales_orders", "bronze", None, None, False, None, None),
        ],
    }
    made = {name: spark.createDataFrame(r, model.RAW_SCHEMAS[name]) for name, r in rows.items()}
    made["lineage"] = spark.createDataFrame([("b1", "s1"), ("s1", "g1"), ("g1", "g2"), ("b3", "g2")], "source string, target string")
    made["rerun_costs"] = spark.createDataFrame([("b1", 700)], "table_id string, rerun_cost_usd int")
    made["executive"] = spark.createDataFrame([("g2",)], "table_id string")
    return made


@pytest.fixture(scope="module")
def gold(raw):
    return {name: df.cache() for name, df in assess(raw, AS_OF).items()}


def test_edits(gold):
    (row,) = gold["gold_bronze_table_edits"].collect()
    assert (row.table_id, row.catalog_schema, row.edit_count_90d, row.severity) == ("b1", "main.sales", 4, "critical")
    assert (row.downstream_gold_table_count, row.last_edit_date, float(row.estimated_rerun_cost_usd)) == (2, dt.date(2024, 6, 30), 700.0)
    assert {r.downstream_table for r in gold["gold_table_dependents"].collect()} == {"g1", "g2"}


def test_edits_name_the_gold_tables_that_depend_on_them(spark, raw, gold):
    assert [r.downstream_gold_tables for r in gold["gold_bronze_table_edits"].collect()] == ["gold_sales_daily,gold_sales_weekly"]
    old = at(300)
    more = [("g3", "gold_sales_daily", "lab", "sales", "gold", "a@x.org", True, "g", False, 1, old, old), ("g4", None, "lab", "sales", "gold", None, True, "g", False, 1, old, old)]
    more = spark.createDataFrame(more * 2, model.RAW_SCHEMAS["raw_ws_tables"])
    given = raw | {"raw_ws_tables": raw["raw_ws_tables"].unionByName(more)}
    given["lineage"] = spark.createDataFrame([("b1", "g4"), ("s1", "g1"), ("b1", "s1"), ("s1", "g3"), ("s1", "g3"), (None, "g1")], "source string, target string")
    given["raw_ws_audit_events"] = raw["raw_ws_audit_events"].unionByName(raw["raw_ws_audit_events"].filter("table_id = 'b1'").withColumn("table_id", F.lit("b3")))
    got = {r.table_id: (r.downstream_gold_table_count, r.downstream_gold_tables) for r in assess(given, AS_OF)["gold_bronze_table_edits"].collect()}
    assert got == {"b1": (3, "g4,gold_sales_daily,gold_sales_daily"), "b3": (0, None)}


def test_health_and_trend(gold):
    health = {r.pipeline_id: r for r in gold["gold_pipeline_health"].collect()}
    assert {k: r.health_status for k, r in health.items()} == {"p1": "critical", "p2": "critical", "p3": "healthy"}
    assert {k: r.anti_pattern_count for k, r in health.items()} == {"p1": 0, "p2": 3, "p3": 1}
    trend = gold["gold_ownership_trend"].collect()
    assert len(trend) == 31 and {(r.total_production_pipelines, r.owned_production_pipelines, r.ownership_coverage_pct) for r in trend} == {(2, 1, 50.0)}


def test_backlog(gold):
    found = gold["gold_remediation_backlog"]
    assert found.select("finding_id").distinct().count() == found.count() == 16
    assert {r.asset_name for r in found.filter("asset_type = 'ml_model' AND severity = 'critical'").collect()} == {"risk"}
    assert {r.asset_name for r in found.filter("asset_type = 'job'").collect()} == {"dump"}
    assert found.filter("asset_type = 'ml_experiment' AND asset_name = 'tried'").count() == 4
    assert found.filter("asset_type = 'table' AND asset_name = 'Orders'").count() == 2


def test_scores(gold):
    scores = gold["gold_health_scores"]
    assert scores.count() == 155
    now = {r.dimension: r for r in scores.filter("report_date = DATE '2024-06-30'").collect()}
    found = gold["gold_remediation_backlog"]
    assert now["overall"].critical_count == found.filter("severity = 'critical'").count()
    assert now["overall"].score == int(sum(r.score for d, r in now.items() if d != "overall") / 4 + 0.5)


def test_user_detector_joins_the_backlog(raw):
    def unnamed(inputs):
        return finding(
            inputs["raw_ws_jobs"], "mine", "medium", "Data Quality", "job", "job_id", "text", "act", 1,
            F.lit("2024-06-30"), 5.0,
        )

    found = assess(raw, AS_OF, detectors={"mine": unnamed})["gold_remediation_backlog"]
    assert found.filter("description = 'text'").count() == 2


def test_missing_inputs_are_named(raw):
    with pytest.raises(ValueError, match="raw_ws_jobs"):
        assess({k: v for k, v in raw.items() if k != "raw_ws_jobs"}, AS_OF)


def test_described_results_answer_sql(spark, gold):
    edits = described(
        gold["gold_bronze_table_edits"], {"table_id": {"hidden": True}, "severity": {"comment": "how bad", "synonyms": ["risk"]}}
    )
    publish_views({"edits_view": edits})
    assert "table_id" not in edits.columns
    assert edits.schema["severity"].metadata["synonyms"] == ["risk"]
    got = spark.sql("SELECT table_name FROM edits_view WHERE severity = :s ORDER BY edit_count_90d DESC", {"s": "critical"})
    assert got.first().table_name == "bronze_sales_orders"


def test_costs_are_made_for_edited_tables_only(spark, raw, monkeypatch):
    read, cost = [], lineage.rerun_cost
    monkeypatch.setattr(lineage, "rerun_cost", lambda runs, reads, *more: (read.extend(r.table_id for r in reads.collect()), cost(runs, reads, *more))[1])
    given = {name: df for name, df in raw.items() if name != "rerun_costs"}
    given["reads"] = spark.createDataFrame([("b1", "p1"), ("b1", "p1"), ("b1", "p3"), ("b3", "p1"), (None, "p1")], "table_id string, pipeline_id string")
    (row,) = assess(given, AS_OF)["gold_bronze_table_edits"].collect()
    assert read == ["b1", "b1", "b1"]
    assert float(row.estimated_rerun_cost_usd) == 20.28
