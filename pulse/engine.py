"""Named analytic calls over stored tables, and the same as SQL table functions."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions import params
from pulse.functions.columns import mood_label
from pulse.functions.filters import latest
from pulse.operators import derived, posts, trending
from pulse.sources.tables import read_table


class Engine:
    """One method per analytic call, each a DataFrame. "Now" is `as_of`, else the newest post."""

    def __init__(self, posts: DataFrame, trending: DataFrame, as_of=None):
        self.posts, self.trending = posts, trending
        self.as_of = latest(posts) if as_of is None else as_of

    @classmethod
    def open(cls, spark: SparkSession, folder: str, as_of=None) -> "Engine":
        return cls(
            read_table(spark, "social_posts", folder), read_table(spark, "trending_topics", folder), as_of
        )

    @staticmethod
    def _platform(platform):
        if platform is not None:
            params.one_of(platform, (*params.PLATFORMS, "all"), "platform")
        return platform

    def trending_topics(self, platform=None, hours=None, limit=10, timeframe=None, min_mentions=0):
        params.between(limit, 1, params.MAX_LIMIT, "limit")
        span = params.resolve_hours(hours, timeframe)
        return trending.trending_topics(
            self.trending, self._platform(platform), span, limit, self.as_of, min_mentions
        )

    def sentiment_overview(self, platform=None, hours=None, timeframe=None, topic=None) -> DataFrame:
        span = params.resolve_hours(hours, timeframe)
        return posts.sentiment_distribution(self.posts, self._platform(platform), span, self.as_of, topic)

    def sentiment_trend(self, platform=None, hours=None, timeframe=None) -> DataFrame:
        span = params.resolve_hours(hours, timeframe)
        return posts.sentiment_trend_long(self.posts, self._platform(platform), span, self.as_of)

    def overall_mood(self, platform=None, hours=None, timeframe=None) -> DataFrame:
        shares = self.sentiment_overview(platform, hours, timeframe)

        def share(name):
            return F.coalesce(F.max(F.when(F.col("sentiment") == name, F.col("percentage"))), F.lit(0.0))

        return shares.agg(mood_label(share("positive"), share("negative")).alias("mood"))

    def metrics(self) -> DataFrame:
        return posts.platform_metrics(self.posts, 24, self.as_of)

    def summary(self) -> DataFrame:
        return posts.platform_summary(self.metrics())

    def top_hashtags(self, k: int = 20) -> DataFrame:
        return posts.top_hashtags(self.posts, k, 24, self.as_of)

    def time_series(self, metric, platform=None, hours=None, interval=None, timeframe=None) -> DataFrame:
        span = params.resolve_hours(hours, timeframe)
        interval = interval or params.default_interval(span)
        return posts.time_series(self.posts, metric, self._platform(platform), span, interval, self.as_of)

    def realtime_stats(self) -> DataFrame:
        """Last-hour counts with the posting rate and the number of trending topics, as one row."""
        parts = [
            posts.realtime_stats(self.posts, 1, self.as_of),
            posts.posts_per_minute_summary(posts.posts_per_minute(self.posts, self.as_of)),
            trending.trending_count(self.trending, 1, self.as_of),
        ]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return rows.agg(*[F.max(c).alias(c) for c in rows.columns])

    def insights_summary(self, platform=None, hours=None, timeframe=None) -> DataFrame:
        span = params.resolve_hours(hours, timeframe)
        return derived.insights(
            self.posts, self.trending, self._platform(platform), span, self.as_of
        )


def to_json_document(rows: DataFrame, name: str = "data") -> DataFrame:
    """One JSON document per row, under `name`; a list is never built on one task."""
    return rows.select(F.to_json(F.struct(F.struct(*rows.columns).alias(name))).alias("document"))


def register_functions(spark: SparkSession) -> None:
    """SQL functions `get_trending_topics` and `get_sentiment_distribution` with default arguments.

    They read the temporary views `trending_topics` and `social_posts`; "now"
    is the newest post.
    """
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION get_trending_topics(
            for_platform STRING DEFAULT NULL, hours INT DEFAULT 24, top INT DEFAULT 10)
        RETURNS TABLE (topic STRING, mentions BIGINT, sentiment_score DOUBLE, growth_rate DOUBLE,
                       platforms ARRAY<STRING>)
        RETURN
            WITH recent AS (
                SELECT * FROM trending_topics
                WHERE time_window >= (SELECT max(timestamp) FROM social_posts)
                                     - make_interval(0, 0, 0, 0, get_trending_topics.hours)
                  AND (get_trending_topics.for_platform IS NULL
                       OR platform = get_trending_topics.for_platform)
            ), totals AS (
                SELECT topic, sum(mentions_count) AS mentions,
                       coalesce(try_divide(CAST(sum(sentiment_score) AS DOUBLE), count(sentiment_score)), 0D)
                           AS sentiment_score,
                       coalesce(try_divide(CAST(sum(growth_rate) AS DOUBLE), count(growth_rate)), 0D)
                           AS growth_rate,
                       sort_array(collect_set(platform)) AS platforms
                FROM recent GROUP BY topic
            ), ranked AS (
                SELECT *, row_number() OVER (
                    ORDER BY mentions DESC, sentiment_score DESC, topic) AS position
                FROM totals
            )
            SELECT topic, mentions, sentiment_score, growth_rate, platforms
            FROM ranked WHERE position <= get_trending_topics.top
    """)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION get_sentiment_distribution(
            for_platform STRING DEFAULT NULL, hours INT DEFAULT 24)
        RETURNS TABLE (sentiment STRING, count BIGINT, percentage DOUBLE)
        RETURN
            WITH counts AS (
                SELECT sentiment, count(*) AS n FROM social_posts
                WHERE timestamp >= (SELECT max(timestamp) FROM social_posts)
                                   - make_interval(0, 0, 0, 0, get_sentiment_distribution.hours)
                  AND (get_sentiment_distribution.for_platform IS NULL
                       OR platform = get_sentiment_distribution.for_platform)
                  AND sentiment IS NOT NULL
                GROUP BY sentiment
            )
            SELECT sentiment, n, round(n * 100D / sum(n) OVER (), 2) FROM counts
    """)
