"""The package itself for executors that don't have it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the session's Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name, path.relative_to(root)))
    target = Path(tempfile.mkdtemp(prefix="quirefold-"), f"{root.name}.zip")
    target.write_bytes(held.getvalue())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
