"""Written intermediate tables.

A staged table cuts the lineage, survives the loss of executors, and gives
Catalyst the true size of a small side, so that its own threshold decides
between a broadcast and a shuffled join.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it's unset, one in the warehouse.

    Both are seen by the driver and all executors.
    """
    configured = spark.conf.get(_KEY, None)
    if configured:
        return configured
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def new_path(spark: SparkSession) -> str:
    """A new folder name in the shared folder; ``drop_staged`` deletes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _on_files(spark: SparkSession, name: str):
    """A Hadoop path and the file system that it lies on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _on_files(spark, name)
    return files.exists(path)


def remove(spark: SparkSession, name: str) -> bool:
    """Delete a folder this library has written."""
    path, files = _on_files(spark, name)
    return files.delete(path, True)


def staged_count() -> int:
    """How many tables this process has staged and not dropped."""
    return len(_written)


def drop_staged(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Delete tables staged by this process; frames that read them end with it.

    ``first`` and ``last`` choose them as a slice of the order in which they were staged.
    """
    removed = sum(remove(spark, name) for name in _written[first:last])
    del _written[first:last]
    return removed


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    It does so once the driver's collector has met them, which may be long after the last
    use: until then a next step's files come on top. Spark remembers its last query until the
    next one has run, and hears of what Python dropped a moment later; hence the tiny query
    and the pause before the collector runs.
    """
    gc.collect()
    spark.range(1).count()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        drop_staged(spark)
