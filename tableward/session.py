"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "tableward", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder is made only in local mode with nothing set: on a cluster a
    machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tableward-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return named or sc.getCheckpointDir()


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder, remembered for ``release``; nothing is created."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not hasattr(spark.sparkContext, "_tableward_dirs"):
        spark.sparkContext._tableward_dirs = []
    spark.sparkContext._tableward_dirs.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the work folders of this session; returns how many there were.

    Call it when a job's results are written elsewhere: DataFrames built on kept results can't be read after it. Folders
    of jobs that died without it carry their label and a random name under the shared folder and may be expired by age.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = getattr(spark.sparkContext, "_tableward_dirs", [])
    gone = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    paths.clear()
    return gone


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """Write a result to the shared folder and go on from the files.

    This cuts the plan, survives lost executors and fixes values that depend on how rows were split, such
    as row numbers. Columnar files are read back with only the columns needed. What was shuffled for it goes.
    """
    path = new_dir(df.sparkSession, label)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
