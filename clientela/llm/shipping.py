"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import clientela

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to executors, once per Spark application.

    Functions that run in Python workers are found by name there. Spark serves
    the archive from the driver, so no folder has to be shared.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(clientela.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="clientela-")) / "clientela_package.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(root.rglob("*.py")):
            target.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
