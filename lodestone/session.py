"""Makes this package importable on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to every Python worker, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone"), "zip", root, "lodestone")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
