"""Makes the package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers of this context, once. Spark's file server hands the archive to every executor, also to
    those that start later."""
    sc = spark.sparkContext
    if getattr(sc, "_trackloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{HERE.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    sc.addPyFile(str(archive))
    sc._trackloom_shipped = True
