"""Sends the library to the executors, which see no folder of the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the library's packages and top-level modules to the application, once; Spark serves it to every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="sentinel-ship-")) / "sentinel_library.zip"  # read by this driver only
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted([*root.glob("sentinel/**/*.py"), *root.glob("workload/*.py"), *root.glob("corpus_pipeline.py")]):
            archive.write(file, file.relative_to(root).as_posix())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
