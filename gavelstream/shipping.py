"""Send this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once; with --py-files or a shared PYTHONPATH it changes nothing."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).parent
    if not package.is_dir():  # it came as a zip through --py-files, which the executors have too
        return
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    copy = folder / "root" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "root"))
    _sent.add(app)
