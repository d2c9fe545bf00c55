"""Sends this package to the executors' Python workers, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of rows that a Python worker gets at once, where the session leaves Spark's 64 MB: texts may be long, and a worker holds a few batches.
BATCH_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once an application; the archive is made on the driver and served from there. Keeps Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, "1b") == "1b":  # the default given here is what an unset key answers with
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillsift-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
