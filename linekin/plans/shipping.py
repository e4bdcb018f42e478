"""Readies a session: hands the package to Python workers, so that functions that run there can be imported on every machine."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: Rows of a batch for Python workers: rows may be long texts, and a worker holds a batch or two at once.
BATCH_ROWS = "1000"
#: What an unset value is read as.
UNSET = "10001"


def ship(spark: SparkSession) -> None:
    """Adds this package, as a zip file, to the files that Spark sends to its workers, once an application.

    Batches are made smaller where the session has no value of its own; one that is set stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", UNSET) == UNSET:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
