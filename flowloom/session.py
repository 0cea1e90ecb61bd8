"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution. Partition counts stay with the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",  # gb18030 files
        # Call sites of every column expression cost seconds in plans of many rules.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Map and list state with timers (live port scans) need this store.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode with none set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    shared = tempfile.mkdtemp(prefix="flowloom-")
    spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_open_folders: ContextVar[tuple[str, ...]] = ContextVar("flowloom_scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of one job, deleted at its end.

    What :func:`durable` returns inside is only good until then, so a job stores its results elsewhere.
    """
    folder = f"{_shared_folder(spark)}/flowloom-{uuid.uuid4().hex}"
    token = _open_folders.set((*_open_folders.get(), folder))
    try:
        yield folder
    finally:
        _open_folders.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder as Parquet and read it back: the lineage is cut, columns are pruned.

    Inside :func:`scratch` the table goes with the job; otherwise the caller or the cluster clears the shared folder.
    """
    spark, folders = df.sparkSession, _open_folders.get()
    path = f"{folders[-1] if folders else _shared_folder(spark) + '/flowloom'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
