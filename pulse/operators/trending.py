"""Trending topics: detection, growth, read-out, related keywords, trend analysis."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.columns import hour_floor, mean, sentiment_sign, trend_direction, zero_if_null
from pulse.functions.filters import as_of_literal, for_platform, has_hashtags, last_hours

WINDOW = "time_window"


def _mentions(posts: DataFrame, *keys: str) -> DataFrame:
    """Mentions and mean signed sentiment per hashtag, platform and `keys`."""
    return (
        has_hashtags(posts)
        .select(*keys, "platform", "sentiment", F.explode("hashtags").alias("topic"))
        .groupBy(*keys, "topic", "platform")
        .agg(
            F.count("*").alias("mentions_count"),
            F.round(mean(sentiment_sign()), 4).cast("decimal(5,4)").alias("sentiment_score"),
        )
    )


def _by_mentions():
    return [F.desc("mentions_count"), "topic", "platform"]


def detect_trending(posts, as_of=None, hours=1, min_mentions=3, limit=20) -> DataFrame:
    """The most used hashtags of the last hours, stamped with the hour of `as_of`."""
    now = as_of_literal(posts, as_of)
    return (
        _mentions(last_hours(posts, hours, now))
        .filter(F.col("mentions_count") >= min_mentions)
        .orderBy(*_by_mentions())
        .limit(limit)
        .withColumn("now", now)
        .withColumn(WINDOW, hour_floor("now"))
        .drop("now")
    )


def build_trending(posts, min_mentions=3, per_hour=20) -> DataFrame:
    """`detect_trending` for every hour of the posts, with growth.

    Growth is taken over all hashtags of the hour before, so a topic that rises
    into the most used ones has it too. `per_hour=None` keeps every hashtag.
    """
    hourly = with_growth(_mentions(posts.withColumn(WINDOW, hour_floor("timestamp")), WINDOW))
    hourly = hourly.filter(F.col("mentions_count") >= min_mentions)
    if per_hour is None:
        return hourly
    rank = F.row_number().over(Window.partitionBy(WINDOW).orderBy(*_by_mentions()))
    return (
        hourly.withColumn("rank", rank)
        .filter(F.col("rank") <= per_hour)
        .drop("rank")
    )


def _growth():
    ratio = F.col("mentions_count") / F.col("mentions_before")
    return F.round(ratio, 4).cast("decimal(18,4)")


def with_growth(mentions: DataFrame, hours: int = 1) -> DataFrame:
    """Add `mentions_before`, those of the window right before (NULL without one), and `growth_rate`, the ratio to them.

    Only rows of the table count as a window before: pass all groups and cut afterwards.
    """
    series = Window.partitionBy("topic", "platform").orderBy(WINDOW)
    adjacent = F.lag(WINDOW).over(series) == F.col(WINDOW) - F.expr(f"INTERVAL {hours} HOURS")
    before = F.when(adjacent, F.lag("mentions_count").over(series))
    return mentions.withColumn("mentions_before", before).withColumn("growth_rate", _growth())


def with_growth_of(found: DataFrame, posts: DataFrame, as_of=None, hours: int = 1) -> DataFrame:
    """`with_growth` for the few rows of `detect_trending`: posts of the same span right before are counted."""
    now = as_of_literal(posts, as_of)
    earlier = last_hours(posts, 2 * hours, now).filter(F.col("timestamp") < now - F.expr(f"INTERVAL {hours} HOURS"))
    before = _mentions(earlier).select("topic", "platform", F.col("mentions_count").alias("mentions_before"))
    return found.join(before, ["topic", "platform"], "left").withColumn("growth_rate", _growth())


def trending_topics(trending, platform=None, hours=24, limit=10, as_of=None, min_mentions=0):
    recent = for_platform(last_hours(trending, hours, as_of, WINDOW), platform)
    return (
        recent.groupBy("topic")
        .agg(
            F.sum("mentions_count").alias("mentions"),
            zero_if_null(mean("sentiment_score")).alias("sentiment_score"),
            zero_if_null(mean("growth_rate")).alias("growth_rate"),
            F.sort_array(F.collect_set("platform")).alias("platforms"),
        )
        .filter(F.col("mentions") >= min_mentions)
        .orderBy(F.desc("mentions"), F.desc("sentiment_score"), "topic")
        .limit(limit)
    )


def daily_trending(trending: DataFrame, min_total: int = 10) -> DataFrame:
    return (
        trending.groupBy(F.window(WINDOW, "1 day")["start"].alias("day"), "platform", "topic")
        .agg(
            F.sum("mentions_count").alias("total_mentions"),
            mean("sentiment_score").alias("avg_sentiment"),
            F.max("growth_rate").cast("double").alias("peak_growth_rate"),
        )
        .filter(F.col("total_mentions") >= min_total)
    )


def trending_count(trending: DataFrame, hours: int = 1, as_of=None) -> DataFrame:
    return last_hours(trending, hours, as_of, WINDOW).agg(
        F.countDistinct("topic").alias("trending_topics_count")
    )


def trending_summary(topics: DataFrame) -> DataFrame:
    return topics.agg(
        F.count("*").alias("topics"),
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("total_mentions"),
        F.count_if(F.col("sentiment_score") > 0.1).alias("positive_topics"),
        zero_if_null(mean(F.round("growth_rate", 4).cast("decimal(18,4)"))).alias("avg_growth"),
    )


def tag_pairs(posts: DataFrame) -> DataFrame:
    """How often two hashtags share a post.

    Pairs are formed inside each post's own distinct tag list, so nothing is
    joined or shuffled before the partial count.
    """
    tags = posts.select(F.array_distinct("hashtags").alias("tags")).filter(F.size("tags") > 1)
    return (
        tags.select(F.explode("tags").alias("topic"), "tags")
        .select("topic", F.explode("tags").alias("related"))
        .filter(F.col("topic") != F.col("related"))
        .groupBy("topic", "related")
        .agg(F.count("*").alias("together"))
    )


def related_tags(posts: DataFrame, k: int = 5) -> DataFrame:
    """The k hashtags most often used together with each hashtag."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("together"), "related"))
    return tag_pairs(posts).withColumn("rank", rank).filter(F.col("rank") <= k)


def with_related(trending: DataFrame, posts: DataFrame, k: int = 5) -> DataFrame:
    """Fill `related_keywords` of trending rows."""
    keywords = (
        related_tags(posts, k)
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "related")))["related"].alias("related_keywords"))
    )
    return trending.drop("related_keywords").join(keywords, "topic", "left")


def trend_analysis(trending: DataFrame, hours: int = 1) -> DataFrame:
    """Direction from growth, velocity as change of mentions per hour; both need the window before.

    Takes rows of `build_trending` or `with_growth`.
    """
    return (
        trending.withColumn("velocity", (F.col("mentions_count") - F.col("mentions_before")) / hours)
        .filter(F.col("growth_rate").isNotNull())
        .select(
            "topic", "platform", WINDOW, "growth_rate", "velocity",
            trend_direction("growth_rate").alias("trend_direction"),
        )
    )
