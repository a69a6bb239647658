"""This package's code for Python workers on machines that do not have it installed."""

from __future__ import annotations

import tempfile
from pathlib import Path
from zipfile import ZIP_DEFLATED, ZipFile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the application's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="leafmill-code-")) / f"{package.name}.zip"
        with ZipFile(path, "w", ZIP_DEFLATED) as archive:  # sources alone: the package may lie where nothing can be written
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark
