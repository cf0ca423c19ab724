"""Makes this package importable in the Python workers of a session that was started without it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package's source files to the application once, as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_waymark_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="waymark-src-")) / "waymark_src.zip"
    with zipfile.ZipFile(to, "w") as out:
        for f in sorted(_HERE.rglob("*.py")):
            out.write(f, f.relative_to(_HERE.parent))
    sc.addPyFile(str(to))
    sc._waymark_shipped = True
