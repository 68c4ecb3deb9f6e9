"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a session; without it workers could not import its functions."""
    context = spark.sparkContext
    if getattr(context, "_tallyspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp()) / "tallyspark.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(where))
    context._tallyspark_shipped = True
