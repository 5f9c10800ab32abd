"""Tables written to the shared folder, and joins whose small side is checked before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when rows x estimated width stays below this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master; elsewhere an error,
    as executors on other machines could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages start from the files, so a lost executor
    costs only its own tasks. The files are removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """A row's estimated width in memory."""
    return 24 + sum(64 if t in ("string", "binary") or t.startswith(("array", "map", "struct")) else 8 for _, t in df.dtypes)


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``max_bytes``; unchanged (a shuffled join) if they don't.
    Give it a materialised table: its rows are counted from the files' footers."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= max_bytes else df
