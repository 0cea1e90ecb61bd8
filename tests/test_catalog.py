import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["customer", "documents", "events", "nation", "orders", "pages", "supplier"]
SAMPLE = ["a21_process_attribution", "b8_traffic_trend", "b12_activity_summary", "c12_download_upload", "d12_tag_technical",
          "e9_beaconing", "f1_features", "g9_port_scan_windows", "i3_address_reputation"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 150


def test_entry_blocks_scanners(spark):
    out = entry.entry(spark)
    assert out.columns == ["target_type", "target", "max_score", "reasons", "action", "ttl_minutes"] and out.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_without_broadcast_joins(spark, small, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = entry.queries()[name](spark, small)
        columns = sorted(frame.columns)
        got = sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
