"""Where intermediate tables live, and how long plans are cut."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: What goes to a Python worker at once while a table is written in passing; Spark's own bound is 64 MB.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    driver's own disk is invisible to the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="riskframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table written in passing."""
    return f"{shared_folder(spark).rstrip('/')}/riskframe/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside send ``BATCH_BYTES`` at once, unless the session says otherwise; after it, what held before."""
    name, value = BATCH_BYTES
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written in passing, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Tables written in passing under the shared folder and deleted together."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again: its lineage ends in files that outlive executors."""
        path = scratch_path(self.spark, self.label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, count: int) -> None:
        """Delete the ``count`` oldest tables."""
        for path in self.paths[:count]:
            drop_table(self.spark, path)
        del self.paths[:count]

    def __enter__(self) -> "Shelf":
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            drop_table(self.spark, self.paths.pop())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
