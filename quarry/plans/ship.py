"""Sends the package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: the package as a zip file on every worker's import path."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        to = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry_package.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "quarry")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(to)
        _SENT.add(app)
    return spark
