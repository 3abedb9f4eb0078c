"""Smaller Arrow batches while texts go through Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> Iterator[None]:
    """Jobs run inside take at most ``rows`` rows and about ``size`` bytes a batch, which bounds a task's memory for texts.

    A single longer text is a batch of its own. The settings are put back after.
    """
    before = {name: spark.conf.get(name) for name in (_ROWS, _BYTES)}
    for name, most in ((_ROWS, rows), (_BYTES, size)):
        now = int(before[name]) if before[name].lstrip("-").isdigit() else 0
        spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
