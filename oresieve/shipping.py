"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of a session, once, unless PYTHONPATH or the working folder gives it to them already."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in paths or os.path.abspath(os.getcwd()) == ROOT:
        return
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "oresieve.zip")  # on the driver only; it serves the file to all workers
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(ROOT, "oresieve")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, ROOT))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
