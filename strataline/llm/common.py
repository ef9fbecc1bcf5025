"""What several corpus operators share: reading, durable stages, held-out folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: batches of texts for Python; the engine's own bound is 64 MB, which each side holds several times over
BATCH_BYTES = 8 << 20

_owned: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a local one if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    This cuts the lineage, and a lost executor costs only the tasks it ran.
    ``discard`` deletes the folder; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _owned[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Deletes durable stages that nothing reads any more."""
    for stage in stages:
        _delete(stage.stage_path)


def stages_since(before: set[str], *kept: DataFrame) -> list[str]:
    """Paths of the durable stages made since ``before`` (a copy of ``stage_paths()``) but for the kept ones."""
    spared = {k.stage_path for k in kept}
    return [p for p in _owned if p not in before and p not in spared]


def stage_paths() -> set[str]:
    return set(_owned)


def _delete(path: str) -> None:
    spark = _owned.pop(path, None)
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard_paths(paths: list[str]) -> None:
    for path in paths:
        _delete(path)


def in_batches(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow on batches of about ``BATCH_BYTES``, or of what the session has been set to."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if rows.sparkSession.conf.get(key, None) is None:
        rows.sparkSession.conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(work, schema)


@atexit.register
def _drop_stages() -> None:
    for path in list(_owned):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone by now; the other folders are tried all the same
            continue


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int) -> Column:
    """True where the fold is 1.  A null id is in no fold."""
    return F.coalesce(fold(doc_id, folds) == 1, F.lit(False))


def unit_hash(col: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the value and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(seed)), 11) / F.lit(float(1 << 53))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: other columns of the caller can't clash with ours."""
    return df.select(*[df[n] for n in names])


def with_row(docs: DataFrame, carry: bool, **own: Column) -> DataFrame:
    """The columns ``own`` and the text; or, with ``carry``, the whole input row as one struct, ``row``, which holds the text.

    A struct keeps the caller's columns apart from ours, whatever they are called.
    """
    text = F.struct("*").alias("row") if carry else docs["text"].alias("text")
    return docs.select(*[c.alias(n) for n, c in own.items()], text)


def text_of(batch: pa.RecordBatch, at: int) -> pa.Array:
    """The texts of a batch of ``with_row``; ``at`` is the place of the text among the caller's columns."""
    return batch.column("row").field(at) if "row" in batch.schema.names else batch.column("text")


def text_at(docs: DataFrame) -> int:
    return [c.lower() for c in docs.columns].index("text")


def schema_of(rows: DataFrame, names: list[str], more: str) -> StructType:
    """The columns of ``rows`` that are kept, and those that ``more`` declares."""
    kept = [StructField(n, rows.schema[n].dataType, True) for n in names]
    return StructType(kept + StructType.fromDDL(more).fields)
