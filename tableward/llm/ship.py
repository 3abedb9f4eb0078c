"""Sends this package to the executors."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

from tableward.session import shared_dir


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of all tasks, once per session, as an archive in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_tableward_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    name = f"{shared_dir(spark)}/tableward-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    sc.addPyFile(name)
    sc._tableward_shipped = True
