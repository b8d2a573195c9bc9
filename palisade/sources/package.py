"""Sending this package to the executors, for operators that run Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session; the archive is served by the driver, so executors need no shared folder for it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, os.path.join(top.name, path.relative_to(top)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
