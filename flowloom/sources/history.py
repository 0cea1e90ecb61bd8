"""Report history: a Parquet table partitioned by creation date."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.session import durable

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("filename", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("data", T.StringType()),
    T.StructField("created_date", T.DateType())])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_report(spark: SparkSession, path: str, filename: str, body: DataFrame, created_at: datetime) -> int:
    """Store the one-row frame ``body`` as JSON and return the new id."""
    last = 0
    if _exists(spark, path):
        last = read_history(spark, path).agg(F.max("id")).first()[0] or 0
    row = body.select(
        F.lit(last + 1).cast("bigint").alias("id"), F.lit(filename).alias("filename"),
        F.lit(str(created_at)).cast("timestamp_ntz").alias("created_at"), F.to_json(F.struct("*")).alias("data"))
    row.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)
    return last + 1


def find_report(history: DataFrame, report_id: int, body_schema: str | None = None) -> DataFrame:
    """One report with its body parsed; an empty frame when the id is unknown."""
    found = history.where(F.col("id") == report_id)
    body = F.from_json("data", body_schema) if body_schema else F.parse_json("data")
    return found.select("id", "filename", "created_at", body.alias("data"))


def list_reports(history: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; the body column is never read."""
    return (history.select("id", "filename", "created_at")
            .orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit))


def expired(history: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    return history.where(F.col("created_at") < F.lit(str(now - timedelta(days=days))).cast("timestamp_ntz"))


def retained(history: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    return history.where(F.col("created_at") >= F.lit(str(now - timedelta(days=days))).cast("timestamp_ntz"))


def drop_expired(spark: SparkSession, path: str, now: datetime, days: int = 30) -> int:
    """Delete reports older than ``days``; whole days are dropped as folders, one day is rewritten.

    The border day is replaced in one committed overwrite before any folder goes, so a failure at any
    point leaves every kept report in place.
    """
    cutoff = now - timedelta(days=days)
    history = read_history(spark, path)
    old = expired(history, now, days)
    gone = old.count()
    if not gone:
        return 0
    border = history.where(F.col("created_date") == F.lit(cutoff.date()))
    rest = durable(retained(border, now, days))
    kept = not rest.isEmpty()
    if kept:
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_date").parquet(path)
    days_gone = F.col("created_date") < F.lit(cutoff.date()) if kept else F.col("created_date") <= F.lit(cutoff.date())
    whole_days = [r[0] for r in history.where(days_gone).select("created_date").distinct().collect()]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for day in whole_days:
        folder = fs_path(f"{path}/created_date={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
