"""CSV scan with per-file charset and header, quality rules, and canonical sinks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schema as S
from flowloom.functions import scalars as X
from flowloom.sources.canonical import ImportFailure, canonicalise, resolve_columns, synthesised_columns
from flowloom.sources.rownumbers import row_counts, with_row_number

SUPPORTED_EXTENSIONS = ("csv", "pcap", "pcapng", "cap")


@F.pandas_udf(T.BooleanType())
def _is_gb18030(lines: pd.Series) -> pd.Series:
    def fine(raw: bytes) -> bool:
        try:
            raw.decode("gb18030")
            return True
        except UnicodeDecodeError:
            return False

    return lines.map(fine)


def file_dialects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Charset and header line per file, from one distributed pass over all lines.

    The text source hands the raw bytes of each line through, so UTF-8 is judged on the whole
    file without loading it in one piece. Only lines that are no UTF-8 are tried as gb18030;
    what fits neither is read as latin-1, which accepts every byte.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value"), F.monotonically_increasing_id().alias("i"))
    utf8 = F.is_valid_utf8("value")
    broken = lines.where(~utf8).select("file", _is_gb18030(F.col("value").cast("binary")).alias("gb"))
    other = broken.groupBy("file").agg(F.when(F.bool_and("gb"), "gb18030").otherwise("ISO-8859-1").alias("other"))
    # Rows of a file's first block keep their order inside one partition.
    heads = lines.where(F.col("start") == 0).groupBy("file").agg(
        F.hex(F.min_by(F.col("value").cast("binary"), "i")).alias("header"))
    return heads.join(other, "file", "left").select("file", "header", F.coalesce("other", F.lit("UTF-8")).alias("charset"))


def _dialect_groups(spark: SparkSession, path: str | list[str]) -> list[Row]:
    """Files by charset and header line."""
    groups = (file_dialects(spark, path).groupBy("charset", "header")
              .agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("charset", "header").collect())
    if not groups:
        raise ImportFailure("no data rows")
    return groups


def scan_csv(spark: SparkSession, path: str | list[str], ingest_ts: str | datetime, multi_line: bool = False,
             with_file: bool = False, time_unit: str = "s") -> DataFrame:
    """Canonical flows of CSV files with mixed charsets and headers; ``time_unit`` as in ``canonicalise``.

    Files of one charset and header line are read together. The grouping holds one entry per
    file, like Spark's own file index. ``with_file`` adds source_file (the name), source_path and row (its number in the
    file, 2 for the first below the header). gb18030 needs ``spark.sql.legacy.javaCharsets=true``.
    """
    parts = []
    for group in _dialect_groups(spark, path):
        raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
               .option("encoding", group["charset"]).option("multiLine", multi_line).csv(group["files"]))
        # A byte-order mark belongs to the file, not to the first header.
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
        keep = []
        if with_file:
            raw = with_row_number(raw).withColumn("source_file", F.element_at(F.split("source_path", "/"), -1))
            keep = ["source_file", "source_path", "row"]
        parts.append(canonicalise(raw, ingest_ts, keep, time_unit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def import_report(flows: DataFrame, path: str, kind: str = "CSV") -> tuple[DataFrame, Observation]:
    """Frame that counts its rows while it is written, and the handle to read the counts from."""
    seen = Observation(f"import {kind}")
    return flows.observe(seen, F.count(F.lit(1)).alias("records"),
                         F.count_if(F.col("src_ip") == "unknown").alias("unknown_sources"),
                         F.count_if(F.col("bytes") == 0).alias("zero_byte_rows")), seen


def import_csv(spark: SparkSession, path: str, table: str, ingest_ts: str | datetime, time_unit: str = "s") -> dict[str, object]:
    """Scan, write the flow table, and report records, kind and the columns synthesised in any of the files."""
    missing = [c for group in _dialect_groups(spark, path)
               for c in synthesised_columns([h.lstrip("\ufeff") for h in spark.read.option("header", True).option(
                   "encoding", group["charset"]).csv(group["files"]).columns])]
    frame, seen = import_report(scan_csv(spark, path, ingest_ts, time_unit=time_unit), path)
    write_flows(frame, table)
    return {"type": "CSV", "records": seen.get["records"], "synthesised": sorted(set(missing))}


def write_flows(flows: DataFrame, path: str, mode: str = "append") -> None:
    """Flow table in Parquet, one folder per date, one file set per date and task group."""
    dated = flows.withColumn("date", F.to_date("timestamp"))
    # Rebalancing on the date keeps file sizes even and splits a hot day over several tasks.
    dated.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_canonical_csv(flows: DataFrame, path: str) -> None:
    """The 19 columns with header. Each part file starts with a byte-order mark."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in S.CANONICAL_COLUMNS]
    head, *rest = flows.select(*columns).columns
    (flows.select(*columns).withColumnRenamed(head, "﻿" + head)
     .write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path))


def _replaced_time(raw: DataFrame, time_unit: str) -> list[Column]:
    """The rule for times that ``canonicalise`` replaces; none without a time column."""
    name = resolve_columns(raw.columns).get("timestamp")
    if name is None:
        return []
    value = F.col("`" + name.replace("`", "``") + "`")
    unread = X.parse_time(value, F.lit(None).cast("timestamp_ntz"), time_unit).isNull()
    return [F.when(unread, F.struct(F.lit("replaced_time").alias("rule"), F.coalesce(value, F.lit("")).alias("value")))]


def quality_issues(raw: DataFrame, *keys: str, time_unit: str | None = None) -> DataFrame:
    """Rows breaking a rule: negative or non-integer byte count, wrong field count, with ``time_unit`` also a time not read in it.

    ``raw`` is text-typed; a ``_corrupt`` column (from a permissive read) marks rows whose
    field count is off. One row per broken rule.
    """
    value = F.trim(F.col("bytes").cast("string"))
    number = value.try_cast("decimal(38,0)")
    whole = F.coalesce(value.rlike(r"^[+-]?\d+$"), F.lit(False))
    rules = [F.when(~whole, F.struct(F.lit("invalid_bytes").alias("rule"), F.coalesce(F.col("bytes").cast("string"), F.lit("")).alias("value"))),
             F.when(whole & (number < 0), F.struct(F.lit("negative_bytes").alias("rule"), F.col("bytes").cast("string").alias("value")))]
    if time_unit:
        rules += _replaced_time(raw, time_unit)
    if "_corrupt" in raw.columns:
        wrong = F.col("_corrupt").isNotNull()
        rules = [F.when(~wrong, r) for r in rules]
        rules.append(F.when(wrong, F.struct(F.lit("field_count").alias("rule"), F.col("_corrupt").alias("value"))))
    return raw.select(*keys, F.inline(F.array_compact(F.array(*rules))))


def scan_quality(spark: SparkSession, path: str | list[str], time_unit: str = "s") -> DataFrame:
    """(file, source_path, row, rule, value): quality issues of CSV files by row number, and one row per file with its total.

    Rules are as in :func:`quality_issues`, ``missing_column`` (row 1, one for each file and column; such a file is only
    searched for replaced times) and ``total_rows``, whose value is the number of data rows. Row 1 is the header. Files are read by
    their own charset and header, as in ``scan_csv``.
    """
    parts = []
    keys = ["source_path", "row"]
    for group in _dialect_groups(spark, path):
        reader = spark.read.option("header", True).option("encoding", group["charset"])
        names = [c.strip().lstrip("\ufeff") for c in reader.csv(group["files"]).columns]
        missing = [c for c in S.BASE_COLUMNS if c not in names]
        fields = ", ".join(f"`{c}` STRING" for c in names) + ", _corrupt STRING"
        scan = (reader.option("mode", "PERMISSIVE").option("enforceSchema", True)
                .option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).schema(fields).csv(group["files"]))
        totals = row_counts(scan)
        parts.append(totals.select("source_path", F.lit(1).cast("long").alias("row"), F.lit("total_rows").alias("rule"), F.col("rows").cast("string").alias("value")))
        raw = with_row_number(scan)
        if missing:
            parts.append(totals.select("source_path", F.lit(1).cast("long").alias("row"), F.lit("missing_column").alias("rule"),
                                       F.explode(F.array(*map(F.lit, missing))).alias("value")))
            if rule := _replaced_time(scan, time_unit):
                parts.append(raw.select(*keys, F.inline(F.array_compact(F.array(*rule)))))
            continue
        parts.append(quality_issues(raw, *keys, time_unit=time_unit))
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.element_at(F.split("source_path", "/"), -1).alias("file"), "source_path", "row", "rule", "value")


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Profiles back from JSON with the schema of a profile frame.

    JSON keys are texts: maps are read with text keys and cast to the wanted key type.
    """
    def as_text_keys(kind: T.DataType) -> T.DataType:
        return T.MapType(T.StringType(), kind.valueType) if isinstance(kind, T.MapType) else kind

    texts = T.StructType([T.StructField(f.name, as_text_keys(f.dataType)) for f in like.schema])
    return spark.read.schema(texts).json(path).select(*[F.col(f.name).cast(f.dataType) for f in like.schema])


def export_csv(flows: DataFrame, path: str) -> None:
    flows.write.mode("overwrite").option("header", True).csv(path)


def export_reports(frames: dict[str, DataFrame], path: str) -> None:
    """Every report frame as JSON lines below one folder."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
