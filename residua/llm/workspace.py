"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; an own one only where that is unset and all workers are on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="residua-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Named Parquet tables below one folder of their own; a table survives the loss of any executor.

    Tables are dropped by the operators as soon as no later step reads them; the folder goes with ``clear`` (or
    the end of a ``with`` block), or at the end of the interpreter.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/residua-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def save(self, df: DataFrame, name: str, *partitions: str) -> DataFrame:
        at = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        atexit.unregister(self.clear)
        self._delete(self.path)

    def _delete(self, at: str) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended, and with it the need
            pass
