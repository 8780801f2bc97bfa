"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Tables written to the folder that driver and executors share (spark.checkpoint.dir).

    A written table cuts the lineage: a lost executor costs only the running stage. The folder
    falls back to /tmp/checkpoints where the session names none, as in local tests.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        base = path or spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        df.write.mode(mode).parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        """Have shuffle files of plans that are no longer referenced removed now, not at some later collection.

        A plan that has just run is still held by events under way to Spark's listeners, so these are
        waited for; the second collection finds what the first one has set free.
        """
        context = self.spark.sparkContext
        gc.collect()
        context._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(2):
            context._jvm.System.gc()
            time.sleep(0.2)
