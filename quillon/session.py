"""Making this package known to a cluster's Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application.

    Needed wherever the workers' PYTHONPATH lacks it; harmless elsewhere.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="quillon-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = shutil.copytree(here, Path(folder, "root", here.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(Path(folder, here.name)), "zip", copy.parent))
    _SHIPPED.add(app)
