"""Queries of stored views: filled, and refreshed after a late batch on the days that it changed; equal to the whole."""

from pyspark.sql import functions as F

from pulse.operators import stored_views as V
from pulse.plans.post_queries import _COUNTS
from pulse.plans.registry import QUERIES, query
from pulse.plans.stream_queries import _AHEAD, _ntz, _out_of_order
from pulse.plans.trend_queries import trending
from pulse.session import new_folder
from pulse.sources import adapters as A
from pulse.sources.tables import write_table


def _refreshed_twice(spark, rows, table, name, key, time):
    """Folder of a view that took in all but a tenth of three days, and then these days with it."""
    folder = new_folder(spark, "views")
    late = (F.pmod(F.xxhash64(key), F.lit(10)) == 0) & (F.dayofmonth(time) <= 3)
    write_table(rows.filter(~late), table, folder)
    V.refresh_view(spark, name, folder)
    write_table(rows.filter(late), table, folder)
    V.refresh_view(spark, name, folder)
    return folder


@query("F01_stored_view", QUERIES["F01_hourly_sentiment"].sql, "")
def _(spark, folder):
    view = _refreshed_twice(spark, A.posts(spark, folder), "social_posts", "hourly_sentiment", "post_id", "timestamp")
    return V.read_view(spark, "hourly_sentiment", view).drop("ts_date")


@query("F16_stored_view", QUERIES["F16_user_engagement"].sql, "")
def _(spark, folder):
    view = _refreshed_twice(spark, A.activity(spark, folder), "user_activity", "user_days", "id", "timestamp")
    # keys of the stored table are text
    found = V.stored_user_engagement(A.users(spark, folder), view)
    return found.withColumn("user_id", F.col("user_id").cast(A.users(spark, folder).schema["user_id"].dataType))


@query("F17_stored_view", QUERIES["F17_rollup_metrics"].sql, "")
def _(spark, folder):
    view = _refreshed_twice(spark, A.posts(spark, folder), "social_posts", "metrics", "post_id", "timestamp")
    return V.read_view(spark, "metrics", view).drop("ts_date")


@query("G03_stored_view", QUERIES["G03_daily_trending"].sql, "")
def _(spark, folder):
    view = _refreshed_twice(spark, trending(spark, folder), "trending_topics", "daily_trending", "topic", "time_window")
    return V.read_view(spark, "daily_trending", view).drop("ts_date")


@query(
    "F02_stream_view",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket, platform, count(*) AS post_count, {_COUNTS}
        FROM (SELECT *, {_AHEAD} FROM posts) GROUP BY 1, 2""",
)
def _(spark, folder):
    """Refreshed after each of three batches that come out of time order with copies."""
    target = _out_of_order(
        spark, folder, lambda posts: posts.drop("event_id", "value", "k"), views=("posts_per_hour",)
    )
    return _ntz(V.read_view(spark, "posts_per_hour", target).drop("ts_date"), "bucket")
