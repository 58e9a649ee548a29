"""Stored views: only changed days are worked out, and the result is that of the whole table."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pulse.operators import posts as P
from pulse.operators import stored_views as V
from pulse.session import new_folder
from pulse.sources.tables import note_days, read_table, write_table


def posts_at(spark, *rows):
    """(id, time, sentiment) posts of one platform."""
    layout = "post_id string, timestamp timestamp, sentiment string"
    df = spark.createDataFrame([(i, t and datetime.fromisoformat(t), s) for i, t, s in rows], layout)
    one = F.lit(1)
    return df.withColumns(
        {"platform": F.lit("x"), "author": F.lit("a"), "likes_count": one, "shares_count": one, "comments_count": one}
    ).withColumn("processed_at", F.col("timestamp"))


def same_rows(a, b):
    columns = [c for c in b.columns if c != "ts_date"]
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


FIRST = [("1", "2024-01-01 10:00", "positive"), ("2", "2024-01-01 10:30", "negative"), ("3", "2024-01-03 00:00", None)]


@pytest.mark.parametrize("name", ["hourly_sentiment", "posts_per_hour", "metrics"])
def test_late_rows_refresh_their_day_only(spark, name):
    folder = new_folder(spark, "views")
    write_table(posts_at(spark, *FIRST), "social_posts", folder)
    assert V.refresh_view(spark, name, folder) == [date(2024, 1, 1), date(2024, 1, 3)]
    assert V.refresh_view(spark, name, folder) == []
    write_table(posts_at(spark, ("4", "2024-01-01 23:59", "positive"), ("5", "2024-01-02 01:00", "neutral")), "social_posts", folder)
    assert V.refresh_view(spark, name, folder) == [date(2024, 1, 1), date(2024, 1, 2)]
    whole = V.VIEWS[name].rows(read_table(spark, "social_posts", folder))
    assert same_rows(V.read_view(spark, name, folder), whole)


def test_empty_writes_and_rows_without_a_time(spark):
    folder = new_folder(spark, "views")
    write_table(posts_at(spark, *FIRST).limit(0), "social_posts", folder)
    write_table(posts_at(spark, *FIRST).filter("post_id = '9'"), "social_posts", folder)
    assert V.changed_days(spark, "metrics", folder) == {}
    assert V.refresh_views(spark, folder, ["metrics"]) == {"metrics": []}
    write_table(posts_at(spark, ("1", None, "positive"), *FIRST[1:]), "social_posts", folder)
    assert V.refresh_view(spark, "posts_per_hour", folder) == [None, date(2024, 1, 1), date(2024, 1, 3)]
    assert V.refresh_view(spark, "posts_per_hour", folder) == []
    assert same_rows(V.read_view(spark, "posts_per_hour", folder), P.posts_per_hour(posts_at(spark, *FIRST[1:])))


def test_a_day_that_lost_its_rows_leaves_the_view(spark):
    folder = new_folder(spark, "views")
    write_table(posts_at(spark, *FIRST), "social_posts", folder)
    V.refresh_view(spark, "hourly_sentiment", folder)
    write_table(posts_at(spark, ("1", "2024-01-01 10:00", "positive")).withColumn("processed_at", F.lit(None)), "social_posts", folder, mode="overwrite")
    assert V.refresh_view(spark, "hourly_sentiment", folder) == [date(2024, 1, 1)]
    assert [r["ts_date"] for r in V.read_view(spark, "hourly_sentiment", folder).collect()] == [date(2024, 1, 3)]


def test_failed_refresh_is_repeated_and_old_tables_are_rebuilt(spark, monkeypatch):
    folder = new_folder(spark, "views")
    write_table(posts_at(spark, *FIRST), "social_posts", folder)

    def fail(*_):
        raise OSError

    with monkeypatch.context() as patch:
        patch.setattr(V, "remove_days", fail)  # after the rows are written
        with pytest.raises(OSError):
            V.refresh_view(spark, "metrics", folder)
    assert len(V.changed_days(spark, "metrics", folder)) == 2
    assert len(V.refresh_view(spark, "metrics", folder)) == 2
    assert V.rebuild_view(spark, "metrics", folder) == [date(2024, 1, 1), date(2024, 1, 3)]
    assert same_rows(V.read_view(spark, "metrics", folder), P.rollup_metrics(posts_at(spark, *FIRST)))


def test_only_changed_days_are_read(spark):
    folder = new_folder(spark, "views")
    write_table(posts_at(spark, *FIRST), "social_posts", folder)
    scan = read_table(spark, "social_posts", folder).filter(V.on_days([date(2024, 1, 3)]))
    plan = scan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(ts_date" in plan and "= 2024-01-03" in plan


def test_notes_add_up(spark):
    folder = new_folder(spark, "views")
    for _ in range(2):
        note_days(spark, "social_posts", folder, ["2024-01-01", None])
    assert V.changed_days(spark, "metrics", folder) == {date(2024, 1, 1): 2, None: 2}
