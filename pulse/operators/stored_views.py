"""Views that are stored by day and refreshed only where their source changed.

Writers note the days they changed (`note_days`); a view remembers how many notes of each
day it has taken in, and `refresh_view` works out the days with more of them anew.
"""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators import posts, trending
from pulse.operators.tables import remove_days, stored_yet
from pulse.session import cut_lineage
from pulse.sources.tables import NOTES, note_days, read_table, shape


@dataclass(frozen=True)
class View:
    """`rows` turns whole days of the table `source` into view rows, whose column `time` lies on the day of their source."""

    source: str
    rows: Callable[[DataFrame], DataFrame]
    time: str


#: Sessions run in UTC (`build_session`), so that buckets of a day are the days of the stored tables.
VIEWS = {
    "hourly_sentiment": View("social_posts", posts.hourly_sentiment, "hour"),
    "posts_per_hour": View("social_posts", posts.posts_per_hour, "bucket"),
    "metrics": View("social_posts", posts.rollup_metrics, "time_bucket"),
    "daily_trending": View("trending_topics", trending.daily_trending, "day"),
    "user_days": View("user_activity", posts.activity_days, "day"),
}


def _path(folder: str, name: str) -> str:
    return f"{folder}/views/{name}"


def _counts(spark: SparkSession, path: str, n: Column) -> dict[date | None, int]:
    """A number per day; days are few."""
    layout = "ts_date date, notes long"
    if not stored_yet(lambda: spark.read.schema(layout).parquet(path)):
        return {}
    return dict(spark.read.schema(layout).parquet(path).groupBy("ts_date").agg(n).collect())


def changed_days(spark: SparkSession, name: str, folder: str) -> dict[date | None, int]:
    """Days whose source changed since the view took them in, and the notes that they have now."""
    notes = _counts(spark, f"{folder}/{NOTES}/{VIEWS[name].source}", F.count("*"))
    taken = _counts(spark, f"{_path(folder, name)}_taken", F.max("notes"))
    return {day: n for day, n in notes.items() if n > taken.get(day, 0)}


def on_days(days) -> Column:
    """Rows of these days, as literals, so that no other folder is listed or read."""
    same = F.col("ts_date").isin([day for day in days if day is not None])
    return same | F.col("ts_date").isNull() if None in days else same


def refresh_view(spark: SparkSession, name: str, folder: str) -> list[date | None]:
    """Work out the changed days of a view anew and return them, rows without a time as day None.

    Notes are counted before the source is read: what is written meanwhile counts as changed
    next time. A refresh that fails is repeated by the next one. One refresh of a view may
    run at a time. Days that `drop_expired` deletes from the source stay in the view. A day
    whose source rows are all gone loses its view rows; a view without changes reads notes only.
    """
    view = VIEWS[name]
    days = changed_days(spark, name, folder)
    if not days:
        return []
    source = read_table(spark, view.source, folder).filter(on_days(days))
    rows = view.rows(shape(source, view.source)).withColumn("ts_date", F.to_date(view.time))
    rows = cut_lineage(rows)  # read twice, and aggregates are small beside their source
    left = {day for day, in rows.select("ts_date").distinct().collect()}
    (
        rows.hint("rebalance", F.col("ts_date"))
        .sortWithinPartitions("ts_date", view.time)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ts_date")
        .parquet(_path(folder, name))
    )
    remove_days(spark, _path(folder, name), set(days) - left)
    taken = spark.createDataFrame(list(days.items()), "ts_date date, notes long")
    taken.coalesce(1).write.mode("append").parquet(f"{_path(folder, name)}_taken")
    return sorted(days, key=lambda day: (day is not None, day))


def refresh_views(spark: SparkSession, folder: str, names=tuple(VIEWS)) -> dict[str, list]:
    """`refresh_view` of each view; the days each worked out."""
    return {name: refresh_view(spark, name, folder) for name in names}


def rebuild_view(spark: SparkSession, name: str, folder: str) -> list[date | None]:
    """Note every stored day of the source, as for a table from before notes were kept, and refresh."""
    source = read_table(spark, VIEWS[name].source, folder)
    note_days(spark, VIEWS[name].source, folder, [day for day, in source.select("ts_date").distinct().collect()])
    return refresh_view(spark, name, folder)


def read_view(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Rows of a refreshed view, with `ts_date`, a filter on which prunes folders."""
    return spark.read.parquet(_path(folder, name))


def stored_user_engagement(users: DataFrame, folder: str) -> DataFrame:
    """`user_engagement` from the stored days of users; the log itself is not read."""
    return posts.engagement_of(users, read_view(users.sparkSession, "user_days", folder))
