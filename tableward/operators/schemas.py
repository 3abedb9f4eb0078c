"""Schema policies for incoming data: evolve, rescue, refuse or ignore changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("add_new", "add_new_widen", "rescue", "fail_on_new", "none")
RESCUED = "_rescued_data"

_NUMBER_RANK = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}


class SchemaChangeError(ValueError):
    """The incoming schema differs and the policy is to stop."""


def _widens(old: T.DataType, new: T.DataType) -> bool:
    a, b = _NUMBER_RANK.get(old.simpleString()), _NUMBER_RANK.get(new.simpleString())
    return a is not None and b is not None and b > a


def _new_columns(df: DataFrame, target: T.StructType) -> list[str]:
    return [c for c in df.columns if c not in target.names]


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(name)
    return F.col(name).cast("string")


def _conformed(df: DataFrame, field: T.StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    if df.schema[field.name].dataType == field.dataType:
        return F.col(field.name)
    return F.col(field.name).try_cast(field.dataType)


def _rescue(df: DataFrame, target: T.StructType, extra: list[str], source_path: Column | None) -> Column:
    """JSON of the values that do not fit the target, NULL when all fit."""
    lost = []
    for field in target.fields:
        if field.name in df.columns and df.schema[field.name].dataType != field.dataType:
            misfit = F.col(field.name).isNotNull() & _conformed(df, field).isNull()
            lost.append(F.when(misfit, _as_text(df, field.name)).alias(field.name))
    lost += [_as_text(df, c).alias(c) for c in extra]
    if not lost:
        return F.lit(None).cast("string")
    body = F.struct(*lost, *([source_path.alias("_file_path")] if source_path is not None else []))
    return F.when(F.coalesce(*[c.cast("string") for c in lost]).isNotNull(), F.to_json(body))


def rescued_data(df: DataFrame, target: T.StructType, source_path: Column | None = None) -> DataFrame:
    """Target columns, with unknown and misfitting fields as JSON in ``_rescued_data``."""
    return df.select(
        *[_conformed(df, f).alias(f.name) for f in target.fields],
        _rescue(df, target, _new_columns(df, target), source_path).alias(RESCUED),
    )


def schema_policy(df: DataFrame, target: T.StructType, mode: str, source_path: Column | None = None) -> DataFrame:
    """Bring ``df`` to the target schema under one of the five evolution modes."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    extra = _new_columns(df, target)
    if mode == "fail_on_new":
        retyped = [f.name for f in target.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
        if extra or retyped:
            raise SchemaChangeError(f"new columns {extra}, changed types {retyped}")
        return df.select(*target.names)
    if mode == "none":
        return df.select(*[_conformed(df, f).alias(f.name) for f in target.fields])
    if mode == "rescue":
        return rescued_data(df, target, source_path)
    kept = target
    if mode == "add_new_widen":
        kept = T.StructType(
            [
                T.StructField(f.name, df.schema[f.name].dataType)
                if f.name in df.columns and _widens(f.dataType, df.schema[f.name].dataType)
                else f
                for f in target.fields
            ]
        )
    return df.select(
        *[_conformed(df, f).alias(f.name) for f in kept.fields],
        *extra,
        _rescue(df, kept, [], source_path).alias(RESCUED),
    )


def observed_types(df: DataFrame) -> DataFrame:
    """Narrowest type that fits all values of each text column; other columns keep their own. One pass."""
    entries = []
    for f in df.schema.fields:
        kind = F.lit(f.dataType.simpleString())
        if isinstance(f.dataType, T.StringType):
            c = F.col(f.name)

            def fits(t, c=c):
                return F.count_if(c.isNotNull() & c.try_cast(t).isNull()) == 0

            kind = (
                F.when(F.count(c) == 0, "string")
                .when(fits("bigint"), "bigint")
                .when(fits("double"), "double")
                .otherwise("string")
            )
        entries.append(F.struct(F.lit(f.name).alias("column"), kind.alias("type")))
    return df.agg(F.array(*entries).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two versions, judged by their values."""
    a = observed_types(old).withColumnRenamed("type", "old_type")
    b = observed_types(new).withColumnRenamed("type", "new_type")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return (
        a.join(b, "column", "full_outer")
        .withColumn("change", change)
        .filter("change IS NOT NULL")
        .select("column", "change", "old_type", "new_type")
    )
