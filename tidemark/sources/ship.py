"""Sends this package to the executors, for sessions that were started without it on their Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark application; the driver serves the archive itself."""
    if (app := spark.sparkContext.applicationId) in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "tidemark.zip")
    with zipfile.ZipFile(made, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(made)
    _SENT.add(app)
