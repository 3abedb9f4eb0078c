"""Column expressions used by several operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward import model


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(as_of: str | dt.date) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    return dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def time_literal(df: DataFrame, name: str, day: dt.date) -> Column:
    """The day as a literal of the column's own type, so the filter reaches the scan."""
    return F.lit(day.isoformat()).cast(df.schema[name].dataType)


def in_window(df: DataFrame, name: str, as_of: str | dt.date, days: int) -> Column:
    """The last ``days`` days, the day ``as_of`` included to its end; a timestamp ends the window at its instant."""
    end = as_date(as_of)
    since = F.col(name) >= time_literal(df, name, end - dt.timedelta(days=days))
    if isinstance(as_of, dt.datetime):
        return since & (F.col(name).cast("timestamp") <= F.lit(as_of.isoformat()).cast("timestamp"))
    return since & (F.col(name) < time_literal(df, name, end + dt.timedelta(days=1)))


def is_true(c: str | Column) -> Column:
    """A flag that is set; an unknown one is not."""
    return F.coalesce(col(c), F.lit(False))


def is_false(c: str | Column) -> Column:
    """A flag that is not set or not known."""
    return ~is_true(c)


def day_literal(as_of: str | dt.date) -> Column:
    return F.lit(as_date(as_of))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded; NULL when whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def is_direct_write(entity_type: str | Column = "entity_type") -> Column:
    """Written by hand: no entity at all, a notebook or an ad-hoc query."""
    c = col(entity_type)
    return c.isNull() | c.isin(model.AD_HOC_ENTITY_TYPES)


def is_bronze(schema_name: str | Column = "schema_name", layer_tag: str | Column | None = None) -> Column:
    by_name = F.coalesce(col(schema_name).rlike("_bronze$"), F.lit(False))
    if layer_tag is None:
        return by_name
    return by_name | F.coalesce(col(layer_tag) == "bronze", F.lit(False))


def has_value(c: str | Column) -> Column:
    """Neither NULL nor an empty string."""
    return col(c).isNotNull() & (F.trim(col(c)) != "")


def is_user_email(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike("^[^@ ]+@[^@ ]+[.][a-zA-Z]+$"), F.lit(False))


def breaks_naming(c: str | Column = "table_name") -> Column:
    return ~col(c).rlike(model.NAMING_PATTERN)


def score_band(score: str | Column = "score") -> Column:
    c = col(score)
    return (
        F.when(c < model.SCORE_CRITICAL_BELOW, "critical")
        .when(c < model.SCORE_WARNING_BELOW, "warning")
        .otherwise("healthy")
    )


def severity_rank(c: str | Column = "severity") -> Column:
    return F.when(col(c) == "critical", 1).when(col(c) == "high", 2).otherwise(3)


def sanitized(text: str | Column, chars: int = model.SNIPPET_CHARS) -> Column:
    """Statement text with string and number literals replaced, then cut."""
    no_strings = F.regexp_replace(col(text), "'[^']*'", "?")
    return F.substring(F.regexp_replace(no_strings, "[0-9]+", "?"), 1, chars)


def half_up(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half up, in whole-number arithmetic."""
    return F.when(whole > 0, F.floor((F.lit(200) * part + whole) / (F.lit(2) * whole)).cast("int"))
