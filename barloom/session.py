"""A SparkSession with the settings the engine is written for, and the package on its executors."""

from __future__ import annotations

import importlib.util
import marshal
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC everywhere; AQE coalesces small shuffle partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "barloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def _compiled(path: Path) -> bytes:
    """Byte code that is never compared with its source: workers import it without compiling."""
    return importlib.util.MAGIC_NUMBER + (1).to_bytes(4, "little") + bytes(8) + marshal.dumps(compile(path.read_bytes(), str(path), "exec"))


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the executors' Python path, once per Spark context. Python stages import it there."""
    context = spark.sparkContext
    if not getattr(context, "_barloom_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom_package.zip"  # the driver serves it to the executors
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                name = str(path.relative_to(root.parent))
                z.writestr(name, path.read_bytes())
                z.writestr(name + "c", _compiled(path))
        context.addPyFile(str(archive))
        context._barloom_shipped = True
    return spark
