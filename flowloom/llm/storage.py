"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Named Parquet tables of one job under one folder of their own."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def save(self, name: str, frame: DataFrame) -> DataFrame:
        """Write the frame and read it back, which cuts the lineage."""
        schema = frame.schema
        frame.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of finished jobs now, not when the driver next needs memory.

        What a job leaves behind is only free for a second collection, a moment after the first.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


def partitions(spark: SparkSession, n_bytes: int, each: int) -> int:
    """As many parts as keep each near ``each`` bytes, never fewer than the shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def text_key(text: str = "text"):
    """A short key that tells apart rows with one doc_id and different texts; null for null."""
    return F.pmod(F.xxhash64(text), F.lit(2147483647)).cast("int")
