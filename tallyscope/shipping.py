"""Sends this package's code to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: without it, workers see the package only if it is installed there."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyscope-code-"), "tallyscope.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if not name.endswith(".pyc"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tallyscope", os.path.relpath(full, top)))
    context.addPyFile(path)
    _sent.add(context.applicationId)
