import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.plans import catalog

USERS = [0, 4, 255, 256, 65_535, 65_536, 65_537, 65_540, 90_001, 131_071, 131_072, 540_000, 20_000_000]


@pytest.fixture
def many_users(spark, tmp_path):
    """Events of users whose numbers fit no two bytes, each in frames of every kind."""
    rows = spark.range(13 * len(USERS) * 2).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000).cast("timestamp_ntz").alias("ts"),
        F.get(F.array(*map(F.lit, USERS)), (F.expr("id div 13") % len(USERS)).cast("int")).cast("bigint").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(7.5).alias("value"), F.lit("abc").alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["packet_decode", "packet_cap", "capture_scan", "capture_window", "capture_stream"])
def test_frames_of_any_user_decode_to_what_the_sql_names(spark, many_users, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many_users}/events.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, many_users).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
