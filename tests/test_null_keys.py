"""Rows with NULL keys, unknown kinds and odd times stay in the results."""

from datetime import datetime

from pyspark.sql import functions as F

from pulse.operators import limits as L
from pulse.operators.quality import with_reason
from pulse.operators.tables import upsert

AT = datetime(2024, 1, 1, 12)


def log(spark):
    rows = [
        (1, "c", "/a", "anonymous", AT), (2, None, "/a", "anonymous", AT), (3, "c", None, "robot", AT),
        (4, "c", None, "robot", datetime(2024, 1, 1, 12, 0, 30)),
    ]
    return spark.createDataFrame(rows, "id long, client_id string, endpoint string, user_type string, timestamp timestamp")


def small_limits(spark):
    rows = [("anonymous", None, w, 1) for w in L.WINDOWS.values()]
    return spark.createDataFrame(rows, "user_type string, endpoint string, window_seconds long, max_requests long")


def test_limit_pressure_counts_rows_with_null_keys(spark):
    found = {r.id: r for r in L.limit_pressure(log(spark), small_limits(spark)).collect()}
    assert set(found) == {1, 2, 3, 4}
    assert found[4].before_minute == 1 and found[4].reached == "minute" and found[4].limit_hour == 1


def test_replay_keeps_rows_with_null_keys(spark):
    found = {r.id: r.allowed for r in L.replay_limits(log(spark), small_limits(spark)).collect()}
    assert found == {1: True, 2: True, 3: True, 4: False}


def test_upsert_finds_rows_whose_first_key_is_null(spark):
    schema = "a string, b string, v int"
    old = spark.createDataFrame([(None, "t", 1), ("x", "t", 1)], schema)
    new = spark.createDataFrame([(None, "t", 2), (None, "u", 3)], schema)
    found = upsert(old, new, ["a", "b"], ["v"]).select(*old.columns)
    assert {tuple(r) for r in found.collect()} == {(None, "t", 2), ("x", "t", 1), (None, "u", 3)}


def test_missing_platform_is_bad(spark):
    row = spark.createDataFrame([("hello", None)], "content string, platform string")
    assert with_reason(row).select(F.col("reason")).first()[0] == "missing_platform"
