from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulse import schemas
from pulse.functions.filters import last_hours, today
from pulse.operators import quality as Q
from pulse.operators import tables as T
from pulse.session import new_folder
from pulse.sources.tables import read_table, shape, write_table

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(schemas.TABLES))
def test_every_table_round_trips(name, spark):
    folder = new_folder(spark, "tables")
    time = schemas.TIME_COLUMN[name]
    one = spark.range(1).select(F.lit("2024-01-01 05:00:00").cast("timestamp").alias(time))
    write_table(one, name, folder)
    back = read_table(spark, name, folder)
    assert [f.name for f in back.schema.fields][:-1] == schemas.TABLES[name].names
    assert back.filter("ts_date = '2024-01-01'").count() == 1 and back.filter("ts_date = '2024-01-02'").count() == 0
    assert back.drop("ts_date").schema == schemas.TABLES[name] == shape(back, name).schema


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        read_table(spark, "nothing", "/nowhere")


def test_time_filters_prune_folders(spark):
    folder = new_folder(spark, "tables")
    layout = "service_name string, timestamp timestamp"
    write_table(spark.createDataFrame([("a", T0), ("b", T1)], layout), "system_metrics", folder)
    table = read_table(spark, "system_metrics", folder)
    for recent in (last_hours(table, 1), today(table, T1), T.apply_retention(table, "system_metrics", T1, days=0)):
        plan = recent._jdf.queryExecution().executedPlan().toString()
        assert "ts_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert rows(recent.select("service_name")) == [("b",)]


def test_missing_snapshot_is_zero(spark):
    layout = "struct<posts:bigint,last_updated:timestamp>"
    assert T.read_snapshot(spark, new_folder(spark, "none"), "2024-01-01", layout).first()["posts"] == 0


def test_overwrite_replaces_only_the_days_it_brings(spark):
    folder = new_folder(spark, "tables")
    layout = "service_name string, timestamp timestamp"
    write_table(spark.createDataFrame([("a", T0), ("b", T1)], layout), "system_metrics", folder)
    write_table(spark.createDataFrame([("c", T1)], layout), "system_metrics", folder, mode="overwrite")
    assert rows(read_table(spark, "system_metrics", folder).select("service_name")) == [("a",), ("c",)]


def test_insert_keeps_the_first_of_a_key(spark):
    layout = "post_id string, n int, timestamp timestamp_ntz"
    target = spark.createDataFrame([("a", 1, T0)], layout)
    batch = spark.createDataFrame([("a", 9, T0), ("b", 3, T1), ("b", 2, T0), ("b", 4, T1)], layout)
    assert rows(T.insert_new(target, batch, ["post_id"]).select("post_id", "n")) == [("a", 1), ("b", 2)]


def test_copies_are_cut_before_the_shuffle(spark):
    batch = spark.range(1000).select(F.floor(F.sqrt("id") / 30).alias("post_id"), F.col("id").alias("timestamp"))
    plan = T.first_per_key(batch, ["post_id"], ["timestamp"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_upsert_updates_only_its_columns(spark):
    layout = "k string, n int, note string, updated_at timestamp_ntz"
    old = spark.createDataFrame([("a", 1, "old", None), ("b", 2, "old", T0)], layout)
    new = spark.createDataFrame([("a", None, "new", None), ("c", 7, "new", None)], layout)
    stamp = F.lit("2024-01-02").cast("timestamp_ntz")
    out = {r["k"]: (r["n"], r["note"], r["updated_at"]) for r in T.upsert(old, new, ["k"], ["n"], stamp).collect()}
    assert out == {"a": (None, "old", T1), "b": (2, "old", T0), "c": (7, "new", None)}


def test_cascade_keeps_rows_without_parent_key(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, user_id string")
    parent = spark.createDataFrame([("a",), ("a",)], "user_id string")
    assert rows(T.cascade_delete(child, parent, "user_id").select("id")) == [(1,), (3,)]


def test_retention_bound_is_kept(spark):
    df = spark.createDataFrame([(T0,), (datetime(2024, 1, 31),)], "timestamp timestamp_ntz")
    assert T.apply_retention(df, "social_posts").count() == 2
    assert T.apply_retention(df, "system_metrics").count() == 1
    assert T.apply_retention(df, "rate_limits").count() == 2


def test_merge_leaves_other_days_and_expired_days_go(spark):
    folder, layout = new_folder(spark, "merged"), "topic string, platform string, time_window timestamp, mentions_count int"
    late = datetime(2024, 2, 1)
    T.merge_into(spark.createDataFrame([("a", "x", T0, 1), ("b", None, late, 2)], layout), "trending_topics", folder, [])
    batch = [("b", None, late, 5), ("c", "x", late, 7), ("n", "x", None, 9)]
    for _ in range(2):
        T.merge_into(spark.createDataFrame(batch, layout), "trending_topics", folder, ["mentions_count"])
    stored = read_table(spark, "trending_topics", folder).select("topic", "mentions_count")
    assert rows(stored) == [("a", 1), ("b", 5), ("c", 7), ("n", 9)]
    assert T.drop_expired(spark, "trending_topics", folder, late) == []
    assert T.drop_expired(spark, "trending_topics", folder, late, days=7) == ["2024-01-01"]
    stored = read_table(spark, "trending_topics", folder).select("topic")
    assert rows(stored) == [("b",), ("c",), ("n",)]


def test_json_round_trip(spark):
    kinds = {"m": "map<string,double>", "e": schemas.ENTITIES.simpleString()}
    df = spark.sql(
        "SELECT map('a', 0.5D) AS m, array(named_struct('text', 'x', 'label', 'ORG', 'description', 'd', 'start', 1, 'end', 2, 'confidence', 0.9D)) AS e"
    )
    stored = T.encode_json(df, ["m", "e"])
    assert [f.dataType.simpleString() for f in stored.schema.fields] == ["string", "string"]
    assert T.decode_json(stored, kinds).collect() == df.collect()


def test_snapshot_expires(spark):
    path, layout = new_folder(spark, "snapshot"), "struct<posts:bigint,last_updated:timestamp>"
    T.publish_snapshot(spark.range(1).select(F.lit(5).alias("posts")), path, "2024-01-01 00:00:00")
    T.publish_snapshot(spark.range(1).select(F.lit(6).alias("posts")), path, "2024-01-01 00:00:10")
    assert T.read_snapshot(spark, path, "2024-01-01 00:01:09", layout).first()["posts"] == 6
    assert T.read_snapshot(spark, path, "2024-01-01 00:01:10", layout).first()["posts"] == 0


def test_validation_names_every_reason(spark):
    layout = "post_id string, content string, platform string, sentiment string, sentiment_confidence double, likes_count int, language string, sentiment_scores map<string,double>"
    df = spark.createDataFrame(
        [
            ("ok", "x", "reddit", None, 1.0, 0, "en", {"positive": 1.0}),
            ("blank", " \t ".replace("\t", " "), "reddit", "neutral", 0.0, 0, "en", None),
            ("all", "x" * 5001, "myspace", "glad", 1.5, -1, "xx", {"positive": 2.0}),
            ("null", None, "reddit", "neutral", None, None, None, None),
        ],
        layout,
    )
    good, bad = Q.validate_posts(df)
    assert [r["post_id"] for r in good.collect()] == ["ok"]
    assert {r["post_id"]: r["reason"] for r in bad.collect()} == {
        "blank": "blank_text",
        "all": "long_text,bad_confidence,bad_platform,bad_sentiment,bad_language,negative_likes_count,bad_scores",
        "null": "blank_text",
    }
    assert Q.validate_posts(df, Q.MAX_ENTITY_TEXT)[1].filter("reason LIKE '%long_text%'").count() == 0


def test_constraints(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y"), (None, "y")], "k string, parent string")
    parent = spark.createDataFrame([("x",)], "id string")
    found = Q.check_constraints(df, not_null=["k"], unique=[["k"], ["k", "parent"]], foreign=[("parent", parent, "id")])
    assert {r["constraint_name"]: r["violations"] for r in found.collect()} == {
        "not_null(k)": 2, "unique(k)": 1, "unique(k,parent)": 0, "foreign(parent)": 3,
    }


def test_rows_of_equal_time_have_one_winner(spark):
    """However the copies arrive, the same one of them stays; maps and NULLs count too."""
    at = datetime(2024, 1, 1)
    rows = [("k", at, text, mood) for text in ("b", "a", None) for mood in ({"y": 2.0}, {"x": 1.0}, None)]
    schema = "post_id string, timestamp timestamp, content string, mood map<string,double>"
    target = spark.createDataFrame([], schema)
    for order in (rows, rows[::-1]):
        for named in (1, 5):
            batch = spark.createDataFrame(order, schema).repartition(named)
            [got] = T.new_rows(target, batch, ["post_id"]).collect()
            assert (got.content, got.mood) == (None, {"x": 1.0})
            [other] = T.new_rows(target, batch.filter("content is not null and mood is not null"), ["post_id"]).collect()
            assert (other.content, other.mood) == ("a", {"x": 1.0})
