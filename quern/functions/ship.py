"""Python workers import this package by name; executors get it with the job."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the executors of this context, once."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    place = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern-source.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join(os.path.basename(_PACKAGE), os.path.relpath(path, _PACKAGE)))
    context.addPyFile(place)
    context._quern_shipped = True
