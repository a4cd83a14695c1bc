"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold while a table is written: it replaces the shuffles it was made from, and batches to Python workers are bounded by bytes, however long texts are.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one made here."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quirefold-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there is deleted when the process ends."""
    path = f"{shared_dir(spark)}/quirefold/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder, which survives lost executors and ends the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    given = spark.conf.getAll
    before = {k: given.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for table in tables:
        _delete(table._written_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in [*_written]:
        try:
            _delete(path)
        except Exception:  # the session has ended before; the folder is then left to the cluster's cleaner
            return
