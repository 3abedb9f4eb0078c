"""Change data: latest state, history, snapshot comparison, idempotent loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.skew import with_neighbour


def watermark_extract(source: DataFrame, target: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Source rows from the target's high-water mark on that the target lacks.

    The mark is one value; reading it first puts a literal into the source filter, so files and row groups below it are
    skipped. Rows that carry exactly the mark may have come late, so they are told apart by ``key``.
    """
    mark = target.agg(F.max(column)).first()[0]
    if mark is None:
        return source
    literal = F.lit(mark).cast(source.schema[column].dataType)
    at_mark = target.filter(F.col(column) == F.lit(mark).cast(target.schema[column].dataType)).select(*key)
    return source.filter(F.col(column) >= literal).join(at_mark, key, "left_anti").select(*source.columns)


def idempotent_append(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Target plus the batch rows whose key it lacks; repeated keys in the batch count once."""
    rest = [c for c in batch.columns if c not in key]
    once = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")
    fresh = once.join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def _latest(feed: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    rest = [c for c in feed.columns if c not in key]
    return feed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row")).select(*key, "_row.*")


def upsert_scd1(
    feed: DataFrame, key: list[str], seq: list[str], op: str = "op", target: DataFrame | None = None
) -> DataFrame:
    """Current rows after an insert/update/delete feed that may be out of order.

    The latest change per key is an aggregate with partial results on the map side, so a key with very
    many changes sends one row per task. Target rows carry their ``seq`` and lose only to newer changes.
    """
    changes = feed
    if target is not None:
        changes = target.withColumn(op, F.lit("INSERT")).unionByName(feed)
    return _latest(changes, key, seq).filter(F.col(op) != "DELETE").drop(op)


def scd2_history(
    feed: DataFrame,
    key: list[str],
    seq: list[str],
    values: list[str],
    op: str = "op",
) -> DataFrame:
    """Versions per key with ``valid_from``, ``valid_to`` and ``is_current``.

    Repeats of the same values are folded; a delete closes the open version. ``seq[0]`` must be a time.
    """
    wanted = feed.select(*key, *seq, *values, op)
    seen = with_neighbour(wanted, key, seq, [op, *values], "_prev")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_prev.{v}"))
    gone, was_gone = F.col(op) == "DELETE", F.col(f"_prev.{op}") == "DELETE"
    starts = F.col("_prev").isNull() | was_gone | ~same
    steps = seen.filter(F.when(gone, ~F.coalesce(was_gone, F.lit(True))).otherwise(starts)).drop("_prev")
    return (
        with_neighbour(steps, key, seq, [seq[0]], "_next", forward=True)
        .filter(F.col(op) != "DELETE")
        .select(
            *key,
            *values,
            F.col(seq[0]).alias("valid_from"),
            F.col(f"_next.{seq[0]}").alias("valid_to"),
            F.col("_next").isNull().alias("is_current"),
        )
    )


def _packed(columns: list[str]) -> Column:
    return F.struct(*columns) if len(columns) > 1 else F.col(columns[0])


def _paired(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    left = old.select(*key, _packed(columns).alias("old_value"), F.lit(True).alias("_in_old"))
    right = new.select(*key, _packed(columns).alias("new_value"), F.lit(True).alias("_in_new"))
    return left.join(right, key, "full_outer")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Two full snapshots as an insert/update/delete feed; unchanged rows are left out."""
    op = (
        F.when(F.col("_in_old").isNull(), "INSERT")
        .when(F.col("_in_new").isNull(), "DELETE")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "UPDATE")
    )
    return (
        _paired(old, new, key, columns)
        .withColumn("op", op)
        .filter("op IS NOT NULL")
        .select(*key, "op", "old_value", "new_value")
    )


def apply_diff(old: DataFrame, diff: DataFrame, key: list[str], column: str) -> DataFrame:
    """``old`` moved to the new snapshot by a one-column ``snapshot_diff``."""
    kept = old.join(diff.select(*key), key, "left_anti").select(*key, column)
    changed = diff.filter("op <> 'DELETE'").select(*key, F.col("new_value").alias(column))
    return kept.unionByName(changed)


def full_reconcile(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows only in one side, changed and equal, compared by key over all other columns."""
    columns = [c for c in a.columns if c not in key]
    side = (
        F.when(F.col("_in_new").isNull(), "only_a")
        .when(F.col("_in_old").isNull(), "only_b")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "same")
        .otherwise("changed")
    )
    return _paired(a, b, key, columns).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def multiset_reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in excess on either side when there is no key; one shuffle instead of two ``exceptAll``."""
    signed = a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
    return (
        signed.groupBy(*a.columns)
        .agg(F.sum("_w").alias("_d"))
        .filter("_d <> 0")
        .groupBy(F.when(F.col("_d") > 0, "only_a").otherwise("only_b").alias("side"))
        .agg(F.sum(F.abs("_d")).alias("n"))
    )


def soft_delete_apply(base: DataFrame, deleted: DataFrame, key: list[str]) -> DataFrame:
    return base.join(deleted.select(*key), key, "left_anti")
