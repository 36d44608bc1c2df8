"""Brings this package to the Python workers, wherever the driver imported it from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the driver itself runs from a zip that was shipped
        folder = tempfile.mkdtemp(prefix="tracemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / "tracemill_sources.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, f"tracemill/{source.relative_to(root)}")
        context.addPyFile(str(path))
    _shipped.add(context.applicationId)
