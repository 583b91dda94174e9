"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package to the files of ``spark``'s context, once, so workers can import it wherever they run.

    Workers also get Arrow batches of 4 MB at most, not 64: a batch is held in the
    JVM and in Python at once, by every core.
    """
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="gridloom-ship-")) / "gridloom.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, Path(top.name) / source.relative_to(top))
    context.addPyFile(str(path))
    context._gridloom_shipped = True
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's default; a session's own choice stays
        spark.conf.set(_BATCH, "4m")
