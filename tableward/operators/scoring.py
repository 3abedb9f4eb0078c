"""Daily health scores per dimension, their bands and changes.

The score is 100 x (1 - weighted violations / weighted checks), rounded half up; the weights are 3 for
critical, 2 for high and 1 for medium checks. The overall score is the mean of the dimensions.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableward.functions.common import as_date, breaks_naming, has_value, half_up, score_band, time_literal

WEIGHTS = {"critical": 3, "high": 2, "medium": 1}


def _every_day(counts: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Counts (report_date, n, bad) with a row for each day, and zero where nothing happened."""
    zero = F.lit(0).cast("bigint")
    spine = counts.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("report_date"), zero.alias("n"), zero.alias("bad")
    )
    return (
        counts.filter(F.col("report_date").between(F.lit(first), F.lit(last)))
        .unionByName(spine)
        .groupBy("report_date")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )


def _check(df: DataFrame, dimension: str, weight: str) -> DataFrame:
    return df.select(
        "report_date",
        F.lit(dimension).alias("dimension"),
        F.lit(WEIGHTS[weight]).cast("bigint").alias("weight"),
        F.col("checked").cast("bigint").alias("checked"),
        F.col("violations").cast("bigint").alias("violations"),
    )


def run_checks(runs: DataFrame, as_of, days: int = 30, trailing: int = 30) -> DataFrame:
    """Failed runs among the runs of the ``trailing`` days up to each day."""
    end = as_date(as_of)
    first = end - dt.timedelta(days=days + trailing - 1)
    recent = runs.filter(
        (F.col("start_time") >= time_literal(runs, "start_time", first))
        & (F.col("start_time") < time_literal(runs, "start_time", end + dt.timedelta(days=1)))
    )
    per_day = recent.groupBy(F.to_date("start_time").alias("report_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("bad")
    )
    window = Window.orderBy("report_date").rowsBetween(-(trailing - 1), 0)
    spread = (
        _every_day(per_day, first, end)
        .withColumn("checked", F.sum("n").over(window))
        .withColumn("violations", F.sum("bad").over(window))
        .filter(F.col("report_date") >= F.lit(end - dt.timedelta(days=days)))
    )
    return _check(spread, "etl_hygiene", "critical")


def flag_checks(df: DataFrame, flags: list[tuple[Column, str, str]], as_of, days: int = 30) -> DataFrame:
    """Properties known only as of now count the same on every day.

    ``flags`` lists (violation, dimension, weight); all of them are counted in one pass.
    """
    end = as_date(as_of)
    span = F.sequence(F.lit(end - dt.timedelta(days=days)), F.lit(end))
    counts = [
        F.struct(
            F.lit(dimension).alias("dimension"),
            F.lit(WEIGHTS[weight]).cast("bigint").alias("weight"),
            F.count(F.lit(1)).alias("checked"),
            F.count_if(bad).alias("violations"),
        )
        for bad, dimension, weight in flags
    ]
    return (
        df.agg(F.array(*counts).alias("_all"))
        .select(F.explode("_all").alias("_c"))
        .select(F.explode(span).alias("report_date"), "_c.*")
    )


def ownership_checks(coverage_trend: DataFrame) -> DataFrame:
    daily = coverage_trend.select(
        "report_date", F.col("total").alias("checked"), (F.col("total") - F.col("owned")).alias("violations")
    )
    return _check(daily, "ownership_access", "high")


def table_checks(tables: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Naming and comment checks over the tables that existed on each day."""
    end = as_date(as_of)
    first = end - dt.timedelta(days=days)
    per_day = tables.groupBy(F.greatest(F.lit(first), F.to_date("created_at")).alias("report_date")).agg(
        (F.count(F.lit(1)) * 2).alias("n"),
        (F.count_if(breaks_naming("table_name")) + F.count_if(~has_value("table_comment"))).alias("bad"),
    )
    running = Window.orderBy("report_date")
    daily = (
        _every_day(per_day, first, end)
        .withColumn("checked", F.sum("n").over(running))
        .withColumn("violations", F.sum("bad").over(running))
    )
    return _check(daily, "data_quality", "medium")


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def health_scores(checks: DataFrame) -> DataFrame:
    """Score per day and dimension, plus ``overall``."""
    weighed = checks.groupBy("report_date", "dimension").agg(
        F.sum(F.col("weight") * F.col("checked")).alias("_c"),
        F.sum(F.col("weight") * F.col("violations")).alias("_v"),
    )
    score = F.coalesce(half_up(F.col("_c") - F.col("_v"), F.col("_c")), F.lit(100))
    each = weighed.select("report_date", "dimension", score.cast("bigint").alias("score"))
    total, n = F.sum("score"), F.count(F.lit(1))
    overall = F.struct(
        F.lit("overall").alias("dimension"), F.floor((total * 2 + n) / (n * 2)).cast("bigint").alias("score")
    )
    # one row per day, holding one entry per dimension
    daily = each.groupBy("report_date").agg(
        F.concat(F.collect_list(F.struct("dimension", "score")), F.array(overall)).alias("_all")
    )
    return daily.select("report_date", F.explode("_all").alias("_s")).select("report_date", "_s.*")


def with_band(scores: DataFrame) -> DataFrame:
    return scores.withColumn("band", score_band())


def score_delta(scores: DataFrame, days: int = 30) -> DataFrame:
    """Change against the score ``days`` days before; NULL where there was none."""
    day = F.datediff("report_date", F.lit(dt.date(1970, 1, 1)))
    then = Window.partitionBy("dimension").orderBy(day).rangeBetween(-days, -days)
    return scores.select(
        "report_date", "dimension", "score", (F.col("score") - F.max("score").over(then)).alias("score_delta_30d")
    )


def _on(scores, as_of):
    return scores.filter(F.col("report_date") == F.lit(as_date(as_of)))


def worst_dimension(scores: DataFrame, as_of) -> DataFrame:
    parts = _on(scores, as_of).filter(F.col("dimension") != "overall")
    return parts.agg(
        F.min_by("dimension", F.struct("score", "dimension")).alias("dimension"), F.min("score").alias("score")
    )


def dimension_scores_now(scores: DataFrame, as_of) -> DataFrame:
    return with_band(_on(scores, as_of)).select("dimension", "score", "band").orderBy("score", "dimension")


def score_trend(scores: DataFrame, dimension: str = "overall") -> DataFrame:
    return (
        scores.filter(F.col("dimension") == dimension)
        .select("report_date", "dimension", "score")
        .orderBy("report_date")
    )


def gold_health_scores(scores: DataFrame, backlog: DataFrame) -> DataFrame:
    """Scores with their 30-day change and the open findings of each dimension."""
    name = (
        F.when(F.col("category") == "ETL Hygiene", "etl_hygiene")
        .when(F.col("category") == "ML/AI Governance", "ml_ai_governance")
        .when(F.col("category") == "Ownership & Access", "ownership_access")
        .when(F.col("category") == "Data Quality", "data_quality")
        .otherwise("overall")
    )
    from tableward.operators.backlog import severity_counts

    open_now = severity_counts(backlog).select(
        name.alias("dimension"),
        F.col("critical_n").alias("critical_count"),
        F.col("high_n").alias("high_count"),
        F.col("medium_n").alias("medium_count"),
    )
    filled = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("critical_count", "high_count", "medium_count")]
    return (
        score_delta(scores)
        .join(open_now, "dimension", "left")
        .select("report_date", "dimension", "score", "score_delta_30d", *filled)
    )


def kpi_counters(scores: DataFrame, backlog: DataFrame, pipelines: DataFrame, as_of) -> DataFrame:
    """One row of headline numbers; three one-row results are stacked and folded."""
    none = F.lit(None).cast("bigint")

    def row(df, **given):
        names = ["overall", "critical_n", "high_n", "medium_n", "unowned_n"]
        return df.agg(*[given[n].cast("bigint").alias(n) if n in given else F.max(none).alias(n) for n in names])

    sev = {f"{s}_n": F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium")}
    stacked = (
        row(_on(scores, as_of).filter("dimension = 'overall'"), overall=F.max("score"))
        .unionByName(row(backlog, **sev))
        .unionByName(row(pipelines, unowned_n=F.count_if(~F.coalesce("has_owner_tag", F.lit(False)))))
    )
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
