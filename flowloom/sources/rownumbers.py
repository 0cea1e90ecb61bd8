"""Row numbers of text files, and row keys from them.

Spark reads a file in blocks, and inside a block rows keep their order. Counting rows per block and adding up the blocks
before gives every row its number in its file, with no shuffle of rows. A key is the number of the file in a
registry beside the table and the place in the file, so two rows never share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.session import durable
from flowloom.sources.canonical import ImportFailure

#: Bits of a key for the place in the file; the bits above, but for the sign, number the file.
PLACE_BITS = 40
#: Rows of a block or file table up to which it is sent to all tasks (some 100 bytes each); beyond, rows are shuffled to it.
SENT = 200_000


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= SENT else small, keys)


def with_row_number(raw: DataFrame, first: int = 2) -> DataFrame:
    """Adds ``source_path`` and ``row`` to rows just read from files: the header is row 1, data begin at ``first``.

    ``raw`` must still be the scan itself, unfiltered. Lines that the reader passes over, such as empty ones, have no number.
    """
    placed = raw.withColumns({"source_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                              "_at": F.monotonically_increasing_id()})
    counts = placed.groupBy("source_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    prior = Window.partitionBy("source_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = durable(counts.withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n"))
    fresh = raw.withColumns({"source_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
                             "_at": F.monotonically_increasing_id()})
    return _joined(fresh, blocks, ["source_path", "_start"]).withColumn(
        "row", F.col("_before") + F.col("_at") - F.col("_low") + first).drop("_start", "_at", "_low", "_before")


def row_counts(raw: DataFrame) -> DataFrame:
    """Data rows per file of a scan."""
    return raw.groupBy(F.col("_metadata.file_path").alias("source_path")).agg(F.count(F.lit(1)).alias("rows"))


def file_numbers(spark: SparkSession, registry: str, paths: DataFrame) -> DataFrame:
    """(source_path, number) of the given paths; new ones get the next numbers, in the order of their names.

    A path keeps its number, so a second ingest gives the same keys. One writer a registry at a time.
    """
    paths = durable(paths.select("source_path").distinct())
    store = spark._jvm.org.apache.hadoop.fs.Path(registry)
    known = None
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        known = durable(spark.read.schema("source_path string, number long").parquet(registry))
    fresh = paths if known is None else paths.join(known, "source_path", "left_anti")
    base = 0 if known is None else (known.agg(F.max("number")).first()[0] or 0) + 1
    # One row a file.
    numbered = durable(fresh.withColumn("number", F.row_number().over(Window.orderBy("source_path")) + F.lit(base - 1).cast("long")))
    last = numbered.agg(F.max("number")).first()[0]
    if last is not None:
        if last >= 1 << 63 - PLACE_BITS:
            raise ImportFailure("too many files for one table")
        numbered.write.mode("append").parquet(registry)
    return numbered if known is None else paths.join(known.unionByName(numbered), "source_path")


def with_flow_id(flows: DataFrame, registry: str, place: str = "row") -> DataFrame:
    """Adds ``flow_id`` from the file's number and the row's place in it; ``flows`` has ``source_path`` and ``place``.

    The same file gives the same keys in every run, whatever its split; rows of different files, also of one name in different folders,
    have different keys.
    """
    numbers = file_numbers(flows.sparkSession, registry, flows.select("source_path"))
    return _joined(flows, numbers, ["source_path"]).withColumn(
        "flow_id", F.col("number") * F.lit(1 << PLACE_BITS) + F.col(place)).drop("number")
