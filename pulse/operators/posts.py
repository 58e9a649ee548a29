"""Aggregates over posts. All are hash aggregates with a partial step before the shuffle."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions import params
from pulse.functions.columns import (
    bucket,
    count_sentiments,
    engagement,
    mean,
    pct,
    sentiment_sign,
    zero_if_null,
)
from pulse.functions.filters import (
    TIME,
    about_topic,
    for_platform,
    has_hashtags,
    last_hours,
    processed,
    since,
    today,
    with_sentiment,
)


def hourly_sentiment(posts: DataFrame) -> DataFrame:
    return (
        processed(posts)
        .groupBy(bucket(TIME, "1 hour").alias("hour"), "platform", "sentiment")
        .agg(
            F.count("*").alias("post_count"),
            mean("sentiment_confidence").alias("avg_confidence"),
            mean(engagement()).alias("avg_engagement"),
        )
    )


def posts_per_hour(posts: DataFrame) -> DataFrame:
    return posts.groupBy(bucket(TIME, "1 hour").alias("bucket"), "platform").agg(
        F.count("*").alias("post_count"), *count_sentiments()
    )


def sentiment_distribution(posts, platform=None, hours=24, as_of=None, topic=None) -> DataFrame:
    """Count and percent per sentiment in one scan: the total comes from the few grouped rows."""
    recent = about_topic(for_platform(with_sentiment(last_hours(posts, hours, as_of)), platform), topic)
    counts = recent.groupBy("sentiment").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("sentiment", "count", pct("count", total).alias("percentage")).orderBy(
        F.desc("count"), "sentiment"
    )


def sentiment_trend_long(posts, platform=None, hours=24, as_of=None) -> DataFrame:
    return (
        for_platform(with_sentiment(last_hours(posts, hours, as_of)), platform)
        .groupBy(bucket(TIME, "1 hour").alias("hour"), "sentiment")
        .agg(F.count("*").alias("count"))
        .orderBy("hour", "sentiment")
    )


def platform_metrics(posts: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    return (
        last_hours(posts, hours, as_of)
        .groupBy("platform")
        .agg(
            F.count("*").alias("total_posts"),
            F.countDistinct("author").alias("unique_users"),
            zero_if_null(mean(engagement())).alias("avg_engagement"),
            *count_sentiments(),
        )
        .orderBy(F.desc("total_posts"), "platform")
    )


def platform_summary(metrics: DataFrame) -> DataFrame:
    """Totals over `platform_metrics`; an author on two platforms counts once on each."""
    return metrics.agg(
        F.coalesce(F.sum("total_posts"), F.lit(0)).alias("total_posts"),
        F.coalesce(F.sum("unique_users"), F.lit(0)).alias("total_unique_users"),
        F.count("*").alias("active_platforms"),
    )


def _tags(posts: DataFrame, *keep) -> DataFrame:
    return has_hashtags(posts).select(*keep, F.explode("hashtags").alias("hashtag"))


def top_hashtags(posts: DataFrame, k: int = 20, hours: int = 24, as_of=None) -> DataFrame:
    return (
        _tags(last_hours(posts, hours, as_of))
        .groupBy("hashtag")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "hashtag")
        .limit(k)
    )


def top_hashtags_by_platform(posts, k: int = 5, hours: int = 24, as_of=None) -> DataFrame:
    ranked = Window.partitionBy("platform").orderBy(F.desc("count"), "hashtag")
    return (
        _tags(last_hours(posts, hours, as_of), "platform")
        .groupBy("platform", "hashtag")
        .agg(F.count("*").alias("count"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
    )


_SERIES_VALUE = {
    "post_volume": lambda: F.count("*").cast("double"),
    "engagement": lambda: zero_if_null(mean(engagement())),
    "user_activity": lambda: F.countDistinct("author").cast("double"),
}


def time_series(posts, metric, platform=None, hours=24, interval="1h", as_of=None) -> DataFrame:
    """One row per bucket; `sentiment_trend` has one column per sentiment, NULL where absent."""
    params.one_of(metric, params.SERIES_METRICS, "metric")
    start = bucket(TIME, params.interval_text(interval)).alias("bucket")
    recent = for_platform(last_hours(posts, hours, as_of), platform)
    if metric == "sentiment_trend":
        grouped = with_sentiment(recent).groupBy(start)
        return grouped.pivot("sentiment", list(params.SENTIMENTS)).count().orderBy("bucket")
    return recent.groupBy(start).agg(_SERIES_VALUE[metric]().alias("value")).orderBy("bucket")


def realtime_stats(posts: DataFrame, hours: int = 1, as_of=None) -> DataFrame:
    return last_hours(posts, hours, as_of).agg(
        F.count("*").alias("posts"),
        F.countDistinct("author").alias("active_users"),
        zero_if_null(mean("processing_time_ms")).alias("avg_processing_time_ms"),
        *count_sentiments(),
    )


def posts_per_minute(posts, as_of=None, span="10 MINUTES", interval="1 minute", newest=10):
    """Counts of the newest non-empty buckets inside `span`."""
    return (
        since(posts, as_of, span)
        .groupBy(bucket(TIME, interval).alias("minute"))
        .agg(F.count("*").alias("posts"))
        .orderBy(F.desc("minute"))
        .limit(newest)
    )


def posts_per_minute_summary(per_minute: DataFrame) -> DataFrame:
    """Mean over the non-empty buckets and their counts, newest first."""
    newest_first = F.reverse(F.sort_array(F.collect_list(F.struct("minute", "posts"))))
    return per_minute.agg(
        zero_if_null(mean("posts")).alias("posts_per_minute"), newest_first["posts"].alias("trend")
    )


def today_stats(posts: DataFrame, as_of=None) -> DataFrame:
    """Day-so-far counts with distinct authors and hashtags, in one scan.

    Each post gives one entry for its author, with the counts, and one per
    hashtag. Entries are first added up per author and per hashtag.
    """
    counts = [f"{name}_count" for name in params.SENTIMENTS]
    flags = [(F.col("sentiment") == name).cast("int").alias(c) for name, c in zip(params.SENTIMENTS, counts)]
    blank = [F.lit(0).alias(c) for c in counts]
    author = F.struct(F.lit("author").alias("kind"), F.col("author").alias("name"), F.lit(1).alias("posts"), *flags)
    tags = F.transform(
        F.coalesce("hashtags", F.array()),
        lambda tag: F.struct(F.lit("tag").alias("kind"), tag.alias("name"), F.lit(0).alias("posts"), *blank),
    )
    entries = today(posts, as_of).select(F.inline(F.concat(F.array(author), tags)))
    per_name = entries.groupBy("kind", "name").agg(*[F.sum(c).alias(c) for c in ("posts", *counts)])

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    named = F.col("name").isNotNull()
    return per_name.agg(
        total("posts").alias("posts_today"),
        F.count_if((F.col("kind") == "author") & named).alias("active_users"),
        *[total(c).alias(c) for c in counts],
        F.count_if((F.col("kind") == "tag") & named).alias("trending_topics"),
    )


def activity_days(activity: DataFrame) -> DataFrame:
    """Requests, their time and the last one, per user and day."""
    return activity.groupBy("user_id", F.to_date(TIME).alias("day")).agg(
        F.count("*").alias("requests"),
        F.sum("processing_time_ms").alias("ms"),
        F.count("processing_time_ms").alias("timed"),
        F.max(TIME).alias("last"),
    )


def engagement_of(users: DataFrame, days: DataFrame) -> DataFrame:
    """Every user with the totals of `activity_days`."""
    per_user = days.groupBy("user_id").agg(
        F.sum("requests").alias("total_requests"),
        F.count("day").alias("active_days"),
        F.try_divide(F.sum("ms").cast("double"), F.sum("timed")).alias("avg_response_time"),
        F.max("last").alias("last_activity"),
    )
    return (
        users.select("user_id", "username")
        .join(per_user, "user_id", "left")
        .na.fill(0, subset=["total_requests", "active_days"])
    )


def user_engagement(users: DataFrame, activity: DataFrame) -> DataFrame:
    """Every user with request totals; the log is reduced to one row per user before the join."""
    return engagement_of(users, activity_days(activity))


def rollup_metrics(posts: DataFrame, sizes=(3600, 86400)) -> DataFrame:
    """Volume, engagement and sentiment per platform (NULL = all) and bucket of each size.

    Posts are read once into the smallest size; larger buckets add those rows up.
    """
    base = min(sizes)
    if any(size % base for size in sizes):
        raise ValueError("every bucket size must be a multiple of the smallest")
    small = posts.groupBy("platform", bucket(TIME, f"{base} seconds").alias("base")).agg(
        F.count("*").alias("posts"),
        F.sum(engagement()).alias("engagement"),
        F.count(engagement()).alias("engaged"),
        F.sum(sentiment_sign()).alias("sign"),
    )

    def of_size(size):
        start = small.withColumn("time_bucket", bucket("base", f"{size} seconds"))
        return (
            start.groupingSets(
                [["platform", "time_bucket"], ["time_bucket"]], "platform", "time_bucket"
            )
            .agg(
                F.sum("posts").cast("double").alias("volume"),
                F.try_divide(F.sum("engagement").cast("double"), F.sum("engaged")).alias("engagement"),
                F.try_divide(F.sum("sign").cast("double"), F.sum("posts")).alias("sentiment"),
            )
            .withColumn("bucket_seconds", F.lit(size).cast("long"))
        )

    wide = reduce(DataFrame.unionByName, [of_size(size) for size in sizes])
    return wide.unpivot(
        ["platform", "time_bucket", "bucket_seconds"],
        ["volume", "engagement", "sentiment"],
        "metric_name",
        "value",
    )


def average_sentiment(posts, platform=None, hours=24, as_of=None, topic=None) -> DataFrame:
    recent = about_topic(for_platform(last_hours(posts, hours, as_of), platform), topic)
    return recent.agg(zero_if_null(mean(sentiment_sign())).alias("average_sentiment"))


def polar_topics(posts, k=5, platform=None, hours=24, as_of=None, topic=None) -> DataFrame:
    """The k hashtags with the highest and the k with the lowest mean sentiment."""
    recent = about_topic(for_platform(last_hours(posts, hours, as_of), platform), topic)
    scored = (
        _tags(recent, "sentiment")
        .groupBy("hashtag")
        .agg(F.count("*").alias("mentions"), mean(sentiment_sign()).alias("score"))
    )

    def top(kind, order, keep):
        ranked = scored.filter(keep).orderBy(order, F.desc("mentions"), "hashtag").limit(k)
        return ranked.select(F.lit(kind).alias("kind"), F.col("hashtag").alias("topic"), "mentions", "score")

    return top("positive", F.desc("score"), F.col("score") > 0).unionByName(
        top("negative", F.asc("score"), F.col("score") < 0)
    )


def analytics_report(posts, metrics, platform=None, hours=24, as_of=None) -> DataFrame:
    """Chosen metrics per platform in long form."""
    metrics = params.all_of(metrics, params.REPORT_METRICS, "metrics")
    recent = for_platform(last_hours(posts, hours, as_of), platform)
    wide = recent.groupBy("platform").agg(
        mean(sentiment_sign()).alias("sentiment"),
        F.count("*").cast("double").alias("volume"),
        zero_if_null(mean(engagement())).alias("engagement"),
    )
    plain = [m for m in metrics if m != "trending"]
    parts = [wide.unpivot("platform", plain, "metric", "value")] if plain else []
    if "trending" in metrics:
        tags = _tags(recent, "platform").groupBy("platform")
        parts.append(
            tags.agg(F.countDistinct("hashtag").cast("double").alias("value")).withColumn(
                "metric", F.lit("trending")
            )
        )
    return reduce(DataFrame.unionByName, parts)
