"""Gives the package's code to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package as a zip file, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="twinline-"), "twinline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(os.path.join(_ROOT, "twinline")):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, _ROOT))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
