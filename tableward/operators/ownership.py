"""Who owns what: unowned assets, coverage, its trend and forecast."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableward import model
from tableward.functions.common import as_date, day_literal, has_value, is_false, is_true, is_user_email, ratio

_ID_COLUMNS = {
    "pipeline": "pipeline_id",
    "table": "table_id",
    "job": "job_id",
    "ml_model": "model_id",
    "ml_experiment": "experiment_id",
}


def unowned_assets(**assets: DataFrame) -> DataFrame:
    """Assets without a resolvable owner; pass any of pipeline, table, job, ml_model, ml_experiment."""
    found = None
    for kind, df in assets.items():
        part = df.filter(~has_value("owner_email")).select(
            F.lit(kind).alias("asset_type"), F.col(_ID_COLUMNS[kind]).cast("string").alias("asset_id")
        )
        found = part if found is None else found.unionByName(part)
    return found


def unowned_production(pipelines: DataFrame) -> DataFrame:
    return pipelines.filter(is_false("has_owner_tag") & is_true("is_production")).select("pipeline_id", "pipeline_name")


def owner_kind(tables: DataFrame, groups: DataFrame) -> DataFrame:
    """Tables by kind of owner. Owners are counted before the join, so one big owner is one row."""
    owners = tables.groupBy("owner_email").agg(F.count(F.lit(1)).alias("n"))
    listed = groups.select(F.col("principal").alias("owner_email"), F.lit(True).alias("_group")).distinct()
    kind = (
        F.when(~has_value("owner_email"), "none")
        .when(F.col("_group"), "group")
        .when(is_user_email("owner_email"), "user")
        .otherwise("service_principal")
    )
    return (
        owners.join(listed, "owner_email", "left")
        .withColumn("owner_kind", F.coalesce(kind, F.lit("none")))
        .groupBy("owner_kind")
        .agg(F.sum("n").alias("n"))
    )


def individual_grants(grants: DataFrame) -> DataFrame:
    """Share of grants held by named users; the window runs over one row per kind."""
    kind = F.when(is_user_email("principal"), "user").otherwise("group")
    return (
        grants.groupBy(kind.alias("principal_kind"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()), 4))
    )


def offending_grants(grants: DataFrame) -> DataFrame:
    """Grants held by named users instead of groups or service principals, one row each."""
    return grants.filter(is_user_email("principal")).select("principal", "object", "privilege").distinct()


def long_owned_by_creator(tables: DataFrame, as_of, days: int = 180) -> DataFrame:
    age = F.datediff(day_literal(as_of), F.to_date("created_at"))
    return tables.filter((F.col("owner_email") == F.col("created_by")) & (age > days)).select(
        "table_id", age.alias("days_owned")
    )


def coverage(pipelines: DataFrame, goal: float = model.OWNERSHIP_GOAL_PCT) -> DataFrame:
    pct = ratio(F.col("owned") * 100, F.col("total"), 2)
    return (
        pipelines.filter("is_production")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("has_owner_tag").alias("owned"))
        .select("total", "owned", pct.alias("coverage_pct"), F.round(F.lit(goal) - pct, 2).alias("gap_pct"))
    )


def trend(history: DataFrame, as_of, days: int = 30, goal: float = model.OWNERSHIP_GOAL_PCT) -> DataFrame:
    """Coverage on each of the last ``days`` days.

    Every asset adds to at most two day counters (created, owned); earlier days fold into the first,
    so the running sum sees ``days + 1`` rows and no asset is repeated per day.
    """
    end = as_date(as_of)
    first, last = F.lit(end - dt.timedelta(days=days)), F.lit(end)
    one, zero = F.lit(1), F.lit(0)
    owned_from = F.when(F.col("owned_at").isNotNull(), F.greatest("created_at", "owned_at"))

    def counter(at, created, owned):
        return F.struct(F.to_date(at).alias("day"), created.alias("created"), owned.alias("owned"))

    marks = history.select(
        F.explode(F.array(counter(F.col("created_at"), one, zero), counter(owned_from, zero, one))).alias("m")
    ).filter(F.col("m.day") <= last)  # also leaves out assets never owned, whose day is NULL
    marks = marks.select(F.greatest(first, F.col("m.day")).alias("report_date"), "m.created", "m.owned")
    spine = history.sparkSession.range(1).select(
        F.explode(F.sequence(first, last)).alias("report_date"), zero.alias("created"), zero.alias("owned")
    )
    running = Window.orderBy("report_date")
    return (
        marks.unionByName(spine)
        .groupBy("report_date")
        .agg(F.sum("created").alias("_created"), F.sum("owned").alias("_owned"))
        .select(
            "report_date",
            F.sum("_created").over(running).alias("total"),
            F.sum("_owned").over(running).alias("owned"),
        )
        .select(
            "report_date",
            "total",
            "owned",
            ratio(F.col("owned") * 100, F.col("total"), 2).alias("coverage_pct"),
            F.lit(goal).alias("goal_pct"),
        )
    )


def goal_forecast(coverage_trend: DataFrame, goal: float = model.OWNERSHIP_GOAL_PCT) -> DataFrame:
    """Points gained per day and days until the goal; NULL days when coverage does not rise."""
    day = F.datediff("report_date", F.lit(dt.date(1970, 1, 1))).cast("double")
    slope = F.col("slope_per_day")
    return (
        coverage_trend.agg(
            F.round(F.regr_slope(F.col("coverage_pct"), day), 4).alias("slope_per_day"),
            F.max_by("coverage_pct", "report_date").alias("current_pct"),
        )
        .select(
            "slope_per_day",
            "current_pct",
            F.when(slope > 0, F.greatest(F.lit(0), F.ceil((F.lit(goal) - F.col("current_pct")) / slope)))
            .cast("bigint")
            .alias("days_to_goal"),
        )
    )


def production_split(pipelines: DataFrame) -> DataFrame:
    return (
        pipelines.filter("is_production")
        .groupBy(F.col("has_owner_tag").alias("has_owner"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def trend_report(coverage_trend: DataFrame) -> DataFrame:
    return coverage_trend.select("report_date", "coverage_pct", "goal_pct").orderBy("report_date")
