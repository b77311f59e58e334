"""Makes this package importable in the Python workers of every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _SENT.add(sc.applicationId)
