"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results or plans rely on; a caller's own take precedence.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "engrama", **options: str) -> SparkSession:
    """A session with DEFAULTS; options override them, with "__" for each dot."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in options.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once."""
    sc = spark.sparkContext
    if getattr(sc, "_engrama_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="engrama-")) / "engrama.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._engrama_shipped = True
