"""The package on the executors: zipped and shipped once a session, so that workers can import it wherever it lies."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, the first time that this session asks."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
