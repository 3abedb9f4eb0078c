"""Data-quality rules and checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.common import as_date


def _passes(rule: str) -> Column:
    """A rule that gives NULL has not passed."""
    return F.coalesce(F.expr(rule), F.lit(False))


def _stacked(df: DataFrame, name: str, rows: dict[str, list[Column]], fields: list[str]) -> DataFrame:
    """One-row aggregates turned into one row per entry."""
    entries = [
        F.struct(F.lit(key).alias(name), *[v.alias(f) for f, v in zip(fields, values, strict=True)])
        for key, values in rows.items()
    ]
    return df.agg(F.array(*entries).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def expectation_metrics(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Passed and failed rows per rule, all rules in one pass."""
    rows = {n: [F.count_if(_passes(r)), F.count_if(~_passes(r))] for n, r in rules.items()}
    return _stacked(df, "rule", rows, ["passed", "failed"])


def expectations(df: DataFrame, rules: dict[str, str], policy: str = "warn", observe: str | None = None) -> DataFrame:
    """Apply rules to rows: ``warn`` keeps all, ``drop`` filters, ``fail`` raises at the first bad row.

    ``observe`` names the metrics that Spark reports while the data pass, in batch and in streams.
    """
    if policy not in ("warn", "drop", "fail"):
        raise ValueError(f"unknown policy {policy}")
    if observe:
        df = df.observe(observe, *[F.count_if(~_passes(r)).alias(n) for n, r in rules.items()])
    all_pass = F.lit(True)
    for r in rules.values():
        all_pass = all_pass & _passes(r)
    if policy == "drop":
        return df.filter(all_pass)
    if policy == "fail":
        names = failed_rules(rules)
        message = F.concat(F.lit("expectation failed: "), F.array_join(names, ","))
        return df.filter(F.when(all_pass, True).otherwise(F.raise_error(message).cast("boolean")))
    return df


def failed_rules(rules: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(~_passes(r), F.lit(n)) for n, r in rules.items()]))


def quarantine(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``failed_rules``)."""
    marked = df.withColumn("failed_rules", F.array_join(failed_rules(rules), ","))
    return marked.filter("failed_rules = ''").drop("failed_rules"), marked.filter("failed_rules <> ''")


def not_null_unique_check(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a NULL in the key, and key values found more than once."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rows = {
        "null_key": [F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0))],
        "duplicate_key": [F.count_if((F.col("_n") > 1) & ~missing)],
    }
    return _stacked(counts, "check", rows, ["bad_n"])


def fk_check(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent. References are counted first: a hot one is one row."""
    refs = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("_n"))
    orphans = refs.join(parent.select(F.col(parent_key).alias("_ref")), "_ref", "left_anti")
    return orphans.agg(F.lit("orphan_reference").alias("check"), F.coalesce(F.sum("_n"), F.lit(0)).alias("bad_n"))


def interval_check(df: DataFrame, start: str, end: str, duration: str | None = None) -> DataFrame:
    """Intervals that end before they start, and durations that disagree with them."""
    rows = {"end_before_start": [F.count_if(F.col(end) < F.col(start))]}
    if duration is not None:
        span = F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
        rows["wrong_duration"] = [F.count_if(span != F.col(duration))]
    return _stacked(df, "check", rows, ["bad_n"])


def freshness_check(
    df: DataFrame, time: str, as_of, max_age_days: int, min_rows: int = 1, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Latest time, age and rows, of the whole or per ``keys`` (such as the table), in one grouped pass."""
    age = F.datediff(F.lit(as_date(as_of)), F.to_date("max_ts"))
    return df.groupBy(*keys).agg(F.max(time).alias("max_ts"), F.count(F.lit(1)).alias("n")).select(
        *keys,
        "max_ts",
        age.alias("age_days"),
        "n",
        (F.coalesce(age <= max_age_days, F.lit(False)) & (F.col("n") >= min_rows)).alias("ok"),
    )


def older_than(df: DataFrame, time: str, as_of, days: int) -> DataFrame:
    cut = as_date(as_of) - dt.timedelta(days=days)
    return df.filter(F.col(time) < F.lit(cut.isoformat()).cast(df.schema[time].dataType))


def column_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows, NULLs, distinct values, least and greatest value per column (values as text).

    ``approximate`` takes all figures from one pass, with estimated distinct values. Otherwise distinct values are counted on (column, value) pairs reduced before the shuffle, so no column's values
    meet in one task; the other figures come from one pass without a shuffle of rows.
    """
    columns = columns or df.columns
    figures = {
        c: [
            F.count(F.lit(1)),
            F.count_if(F.col(c).isNull()),
            F.min(c).cast("string"),
            F.max(c).cast("string"),
        ]
        for c in columns
    }
    if approximate:
        for c in columns:
            figures[c].insert(2, F.approx_count_distinct(c))
        return _stacked(df, "column", figures, ["n", "nulls", "ndv", "min", "max"])
    basic = _stacked(df, "column", figures, ["n", "nulls", "min", "max"])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))
    distinct = (
        df.select(pairs.alias("p")).select("p.*").filter("v IS NOT NULL").distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("ndv"))
    )
    return basic.join(distinct, "column", "left").select(
        "column", "n", "nulls", F.coalesce("ndv", F.lit(0)).cast("bigint").alias("ndv"), "min", "max"
    )
