"""The package on the executors of a cluster."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Send this package to the Python workers of the session's executors; needed where they
    neither have it installed nor find it by PYTHONPATH. Spark serves the archive from the
    driver. Gives its path."""
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='matchwright-')}/matchwright", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    return archive
