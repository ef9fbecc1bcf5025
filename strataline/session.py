"""Sending this package to the executors, and cutting lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_settled: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Executors that can't import the package get it as a zip, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strataline-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def settled(df: DataFrame) -> DataFrame:
    """Computed once: a table in ``spark.checkpoint.dir`` until the driver ends; kept on the executors' disks where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{folder.rstrip('/')}/strataline-settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for spark, path in _settled:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            continue
