"""Ship this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Make ``varistack`` importable in Python workers, wherever they run (once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_varistack_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="varistack-"), "varistack.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_ROOT.rglob("*.py")):
            archive.write(file, file.relative_to(_ROOT.parent))
    sc.addPyFile(path)
    sc._varistack_shipped = True
