"""Queries for filters, projections, data quality and post aggregates."""

from pyspark.sql import functions as F

from pulse.functions import columns as C
from pulse.functions import filters as B
from pulse.operators import posts as P
from pulse.operators import quality as Q
from pulse.operators import trending as G
from pulse.plans.registry import query
from pulse.sources import adapters as A

PAST_DAY = "ts >= {now} - INTERVAL 24 HOUR"


# Filters


@query("B01_last_hours", f"SELECT post_id, ts AS timestamp FROM posts WHERE {PAST_DAY}")
def _(spark, folder):
    return B.last_hours(A.posts(spark, folder), 24).select("post_id", "timestamp")


@query("B02_for_platform", f"SELECT post_id, platform FROM posts WHERE platform = 'reddit' AND {PAST_DAY}")
def _(spark, folder):
    return B.for_platform(B.last_hours(A.posts(spark, folder), 24), "reddit").select("post_id", "platform")


@query("B03_today", "SELECT post_id, ts AS timestamp FROM posts WHERE ts >= date_trunc('day', {now})")
def _(spark, folder):
    return B.today(A.posts(spark, folder)).select("post_id", "timestamp")


@query(
    "B04_processed",
    "SELECT post_id, sentiment FROM posts WHERE processed_at IS NOT NULL AND sentiment IS NOT NULL",
)
def _(spark, folder):
    return B.with_sentiment(B.processed(A.posts(spark, folder))).select("post_id", "sentiment")


@query(
    "B05_has_hashtags",
    "SELECT post_id, array_to_string(hashtags, ',') AS hashtags FROM posts WHERE len(hashtags) > 0",
)
def _(spark, folder):
    return B.has_hashtags(A.posts(spark, folder)).select(
        "post_id", F.array_join("hashtags", ",").alias("hashtags")
    )


@query(
    "B06_min_mentions",
    """SELECT topic, CAST(sum(mentions_count) AS BIGINT) AS mentions FROM recent_trending
       GROUP BY topic HAVING sum(mentions_count) >= 25""",
    "recent_trending",
)
def _(spark, folder):
    posts = A.posts(spark, folder)
    trending = G.build_trending(posts, 1)
    topics = G.trending_topics(trending, limit=50, as_of=B.latest(posts), min_mentions=25)
    return topics.select("topic", "mentions")


@query(
    "B07_topic_filter",
    f"""SELECT sentiment, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
        FROM posts WHERE {PAST_DAY} AND sentiment IS NOT NULL AND list_contains(hashtags, 'tag3')
        GROUP BY sentiment""",
)
def _(spark, folder):
    return P.sentiment_distribution(A.posts(spark, folder), topic="tag3")


# Projections


def project(name, sql, **columns):
    """Register a projection of every post: its id and the given columns."""

    def run(spark, folder):
        return A.posts(spark, folder).select(
            "post_id", *[make().alias(alias) for alias, make in columns.items()]
        )

    query(name, f"SELECT post_id, {sql} FROM posts")(run)


project("C01_engagement", "engagement", engagement=C.engagement)
project("C02_sentiment_sign", "sign", sign=C.sentiment_sign)
project(
    "C03_zero_if_null",
    "coalesce(CAST(processing_time_ms AS DOUBLE), 0.0) AS ms",
    ms=lambda: C.zero_if_null("processing_time_ms"),
)
project(
    "C04_pct",
    "CASE WHEN engagement > 0 THEN round(likes_count * 100.0 / engagement, 2) ELSE 0.0 END AS likes_pct",
    likes_pct=lambda: C.pct("likes_count", C.engagement()),
)
project("C05_hour_floor", "date_trunc('hour', ts) AS hour", hour=lambda: C.hour_floor("timestamp"))
project("C07_to_date", "CAST(ts AS DATE) AS day", day=lambda: F.to_date("timestamp"))
project("C08_iso", "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso", iso=lambda: C.iso("timestamp"))
project(
    "C14_top_label",
    """CASE WHEN likes_count >= shares_count AND likes_count >= comments_count THEN 'likes'
            WHEN shares_count >= comments_count THEN 'shares' ELSE 'comments' END AS label,
       CAST(greatest(likes_count, shares_count, comments_count) AS DOUBLE) AS score""",
    label=lambda: C.top_label(_counts())["key"],
    score=lambda: C.top_label(_counts())["value"],
)


def _counts():
    return F.create_map(
        *[
            part
            for name in ("likes", "shares", "comments")
            for part in (F.lit(name), F.col(f"{name}_count").cast("double"))
        ]
    )


@query(
    "C06_bucket",
    "SELECT post_id, "
    + ", ".join(
        f"time_bucket(INTERVAL '{text}', ts) AS b_{name}"
        for name, text in [("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour"), ("6h", "6 hours"), ("1d", "1 day")]
    )
    + " FROM posts",
)
def _(spark, folder):
    from pulse.functions.params import INTERVALS

    df = A.posts(spark, folder).select("post_id", "timestamp")
    for name, text in INTERVALS.items():
        df = df.withColumn(f"b_{name}", C.bucket("timestamp", text))
    return df.drop("timestamp")


@query(
    "C09_sentiment_label",
    """SELECT topic, platform, time_window,
              CASE WHEN sentiment_score > 0.1 THEN 'Positive' WHEN sentiment_score < -0.1 THEN 'Negative'
                   ELSE 'Neutral' END AS label
       FROM trending""",
    "trending",
)
def _(spark, folder):
    return G.build_trending(A.posts(spark, folder), 1).select(
        "topic", "platform", "time_window", C.sentiment_label().alias("label")
    )


@query(
    "C10_trend_direction",
    """SELECT topic, platform, time_window,
              CASE WHEN growth_rate > 1.2 THEN 'Rising' WHEN growth_rate > 0.8 THEN 'Stable' ELSE 'Falling' END AS direction,
              CASE WHEN growth_rate > 1.5 THEN 'high' WHEN growth_rate > 1.0 THEN 'medium' ELSE 'low' END AS band
       FROM trending WHERE growth_rate IS NOT NULL""",
    "trending",
)
def _(spark, folder):
    grown = G.build_trending(A.posts(spark, folder), 1).filter("growth_rate IS NOT NULL")
    return grown.select(
        "topic", "platform", "time_window", C.trend_direction().alias("direction"), C.growth_band().alias("band")
    )


@query(
    "C11_mood_label",
    """SELECT author, CASE WHEN p > 50 THEN 'Predominantly positive' WHEN n > 50 THEN 'Predominantly negative'
                           ELSE 'Mixed sentiment' END AS mood
       FROM (SELECT author, round(count(*) FILTER (sentiment = 'positive') * 100.0 / count(sentiment), 2) AS p,
                    round(count(*) FILTER (sentiment = 'negative') * 100.0 / count(sentiment), 2) AS n
             FROM posts WHERE sentiment IS NOT NULL GROUP BY author)""",
)
def _(spark, folder):
    known = B.with_sentiment(A.posts(spark, folder)).groupBy("author")
    shares = known.agg(F.count("*").alias("known"), *C.count_sentiments())
    return shares.select(
        "author", C.mood_label(C.pct("positive_count", "known"), C.pct("negative_count", "known")).alias("mood")
    )


@query(
    "C12_fill_unscored",
    """SELECT post_id, coalesce(sentiment, 'neutral') AS sentiment,
              CAST(coalesce(sentiment_confidence, 0.5) AS DOUBLE) AS confidence,
              coalesce(processing_time_ms, 0) AS ms
       FROM posts""",
)
def _(spark, folder):
    return C.fill_unscored(A.posts(spark, folder)).select(
        "post_id", "sentiment", F.col("sentiment_confidence").cast("double").alias("confidence"),
        F.col("processing_time_ms").alias("ms"),
    )


@query(
    "C13_normalise_label",
    """SELECT doc_id, CASE quality + toxic WHEN 2 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS label
       FROM labels""",
    "",
)
def _(spark, folder):
    raw = F.concat(F.lit("LABEL_"), (F.col("quality") + F.col("toxic")).cast("string"))
    return spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", C.normalise_label(raw).alias("label"))


@query(
    "C15_preview",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
       FROM documents""",
    "",
)
def _(spark, folder):
    return A.documents(spark, folder).select("doc_id", C.preview("text").alias("preview"))


_SERIES = f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, {{columns}}
              FROM posts WHERE {PAST_DAY} AND sentiment IS NOT NULL GROUP BY 1"""
_BY_SENTIMENT = "count(*) FILTER (sentiment = '{0}')"


@query(
    "C17_fill_zero",
    _SERIES.replace(
        "{columns}", ", ".join(f"{_BY_SENTIMENT.format(s)} AS {s}" for s in ("positive", "negative", "neutral"))
    ),
)
def _(spark, folder):
    wide = P.time_series(A.posts(spark, folder), "sentiment_trend")
    return C.fill_zero(wide, ["positive", "negative", "neutral"])


# Arrays and data quality


@query("D01_explode_tags", "SELECT post_id, topic FROM tags", "tags")
def _(spark, folder):
    return C.explode_tags(A.posts(spark, folder)).select("post_id", "topic")


@query(
    "D02_collect_platforms",
    "SELECT topic, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM tags GROUP BY topic",
    "tags",
)
def _(spark, folder):
    tags = C.explode_tags(A.posts(spark, folder)).groupBy("topic")
    return tags.agg(F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))


@query(
    "D03_validate_posts",
    """SELECT post_id, concat_ws(',',
              CASE WHEN length(trim(content)) = 0 THEN 'blank_text' END,
              CASE WHEN length(content) > 5000 THEN 'long_text' END,
              CASE WHEN sentiment_confidence < 0 OR sentiment_confidence > 1 THEN 'bad_confidence' END,
              CASE WHEN platform NOT IN ('twitter', 'reddit', 'instagram') THEN 'bad_platform' END,
              CASE WHEN sentiment NOT IN ('positive', 'negative', 'neutral') THEN 'bad_sentiment' END,
              CASE WHEN language NOT IN ('en', 'es', 'fr', 'de', 'it', 'pt', 'nl', 'ru', 'zh', 'ja', 'ko', 'ar')
                   THEN 'bad_language' END) AS reason
       FROM posts_text""",
    "posts_text",
)
def _(spark, folder):
    good, rejected = Q.validate_posts(A.posts_with_text(spark, folder))
    return good.select("post_id", F.lit("").alias("reason")).unionByName(rejected.select("post_id", "reason"))


@query(
    "D03_required_columns",
    """SELECT event_id AS number, concat_ws(',',
              CASE WHEN event_id % 5 = 0 THEN 'missing_post_id' END,
              CASE WHEN event_id % 7 = 0 THEN 'missing_author' END,
              CASE WHEN event_id % 11 = 0 THEN 'missing_timestamp' END,
              CASE WHEN event_id % 13 = 0 THEN 'missing_platform' END) AS reason FROM posts""",
)
def _(spark, folder):
    """Posts of which some lack an id, an author, a time or a platform."""
    posts, number = A.posts(spark, folder), F.split_part("post_id", F.lit("_"), F.lit(2)).cast("long")
    posts = posts.select(number.alias("number"), "post_id", "author", "timestamp", "platform")
    lost = {"post_id": 5, "author": 7, "timestamp": 11, "platform": 13}
    posts = posts.withColumns({c: F.when(F.col("number") % n != 0, F.col(c)) for c, n in lost.items()})
    good, rejected = Q.validate_posts(posts)
    return good.select("number", F.lit("").alias("reason")).unionByName(rejected.select("number", "reason"))


@query(
    "D04_check_constraints",
    """SELECT 'not_null(text)' AS constraint_name, count(*) FILTER (text IS NULL) AS violations FROM documents
       UNION ALL SELECT 'not_null(lang)', count(*) FILTER (lang IS NULL) FROM documents
       UNION ALL SELECT 'unique(doc_id)', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'unique(text)', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'foreign(doc_id)', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "",
)
def _(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return Q.check_constraints(
        A.documents(spark, folder),
        not_null=["text", "lang"],
        unique=[["doc_id"], ["text"]],
        foreign=[("doc_id", labels, "doc_id")],
    )


@query(
    "D05_posts_with",
    "SELECT post_id FROM posts WHERE list_has_any(hashtags, ['tag3', 'click'])",
)
def _(spark, folder):
    return B.posts_with(A.posts(spark, folder), "hashtags", ["tag3", "click"]).select("post_id")


# Aggregates

_COUNTS = ", ".join(f"{_BY_SENTIMENT.format(s)} AS {s}_count" for s in ("positive", "negative", "neutral"))


@query(
    "F01_hourly_sentiment",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, platform, sentiment, count(*) AS post_count,
              CAST(sum(sentiment_confidence) AS DOUBLE) / count(sentiment_confidence) AS avg_confidence,
              avg(engagement) AS avg_engagement
       FROM posts WHERE processed_at IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    return P.hourly_sentiment(A.posts(spark, folder))


@query(
    "F02_posts_per_hour",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, platform, count(*) AS post_count, {_COUNTS}
        FROM posts GROUP BY 1, 2""",
)
def _(spark, folder):
    return P.posts_per_hour(A.posts(spark, folder))


@query(
    "F03_sentiment_distribution",
    f"""SELECT sentiment, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
        FROM posts WHERE {PAST_DAY} AND sentiment IS NOT NULL GROUP BY sentiment""",
)
def _(spark, folder):
    return P.sentiment_distribution(A.posts(spark, folder))


@query(
    "F04_sentiment_trend",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, sentiment, count(*) AS count
        FROM posts WHERE {PAST_DAY} AND sentiment IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, folder):
    return P.sentiment_trend_long(A.posts(spark, folder))


METRICS_SQL = f"""SELECT platform, count(*) AS total_posts, count(DISTINCT author) AS unique_users,
        coalesce(avg(engagement), 0.0) AS avg_engagement, {_COUNTS}
    FROM posts WHERE {PAST_DAY} GROUP BY platform"""


@query("F05_platform_metrics", METRICS_SQL)
def platform_metrics(spark, folder):
    return P.platform_metrics(A.posts(spark, folder))


@query(
    "F06_platform_summary",
    f"""SELECT CAST(sum(total_posts) AS BIGINT) AS total_posts, CAST(sum(unique_users) AS BIGINT) AS total_unique_users,
               count(*) AS active_platforms FROM ({METRICS_SQL})""",
)
def _(spark, folder):
    return P.platform_summary(P.platform_metrics(A.posts(spark, folder)))


@query(
    "F07_top_hashtags",
    f"""SELECT topic AS hashtag, count(*) AS count FROM tags WHERE {PAST_DAY}
        GROUP BY 1 ORDER BY count DESC, hashtag LIMIT 20""",
    "tags",
)
def _(spark, folder):
    return P.top_hashtags(A.posts(spark, folder))


def series(name, metric, value, interval, hours=24):
    span = {"15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}[interval]

    @query(
        name,
        f"""SELECT time_bucket(INTERVAL '{span}', ts) AS bucket, {value} AS value
            FROM posts WHERE ts >= {{now}} - INTERVAL {hours} HOUR GROUP BY 1""",
    )
    def _(spark, folder):
        return P.time_series(A.posts(spark, folder), metric, None, hours, interval)


series("F08_series_post_volume", "post_volume", "CAST(count(*) AS DOUBLE)", "1h")
series("F08_series_post_volume_7d", "post_volume", "CAST(count(*) AS DOUBLE)", "6h", 168)
series("F10_series_engagement", "engagement", "coalesce(avg(engagement), 0.0)", "15m")
series("F11_series_user_activity", "user_activity", "CAST(count(DISTINCT author) AS DOUBLE)", "1d", 168)


@query(
    "F09_series_sentiment",
    _SERIES.replace(
        "{columns}",
        ", ".join(f"nullif({_BY_SENTIMENT.format(s)}, 0) AS {s}" for s in ("positive", "negative", "neutral")),
    ),
)
def _(spark, folder):
    return P.time_series(A.posts(spark, folder), "sentiment_trend")


REALTIME_SQL = f"""SELECT count(*) AS posts, count(DISTINCT author) AS active_users,
        coalesce(avg(processing_time_ms), 0.0) AS avg_processing_time_ms, {_COUNTS}
    FROM posts WHERE ts >= {{now}} - INTERVAL 1 HOUR"""


@query("F12_realtime_stats", REALTIME_SQL)
def _(spark, folder):
    return P.realtime_stats(A.posts(spark, folder))


_NEWEST = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS minute, count(*) AS posts FROM posts
             WHERE ts >= {now} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY minute DESC LIMIT 10"""


@query("F13_newest_buckets", _NEWEST)
def _(spark, folder):
    return P.posts_per_minute(A.posts(spark, folder), None, "24 HOURS", "1 hour")


@query(
    "F13_posts_per_minute",
    """SELECT coalesce(avg(posts), 0.0) AS posts_per_minute, string_agg(posts, ',' ORDER BY minute DESC) AS trend
       FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS posts FROM posts
             WHERE ts >= {now} - INTERVAL 10 MINUTE GROUP BY 1 ORDER BY minute DESC LIMIT 10)""",
)
def _(spark, folder):
    rate = P.posts_per_minute_summary(P.posts_per_minute(A.posts(spark, folder)))
    return rate.withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


@query(
    "F14_trending_count",
    """SELECT count(DISTINCT topic) AS trending_topics_count FROM trending
       WHERE time_window >= {now} - INTERVAL 1 HOUR""",
    "trending",
)
def _(spark, folder):
    posts = A.posts(spark, folder)
    return G.trending_count(G.build_trending(posts, 1), as_of=B.latest(posts))


TODAY_SQL = f"""SELECT count(*) AS posts_today, count(DISTINCT author) AS active_users, {_COUNTS},
        (SELECT count(DISTINCT topic) FROM tags WHERE ts >= date_trunc('day', {{now}})) AS trending_topics
    FROM posts WHERE ts >= date_trunc('day', {{now}})"""


@query("F15_today_stats", TODAY_SQL, "tags")
def _(spark, folder):
    return P.today_stats(A.posts(spark, folder))


@query(
    "F16_user_engagement",
    """SELECT c_custkey AS user_id, c_name AS username, count(id) AS total_requests,
              count(DISTINCT CAST(ts AS DATE)) AS active_days, avg(processing_time_ms) AS avg_response_time,
              max(ts) AS last_activity
       FROM customer LEFT JOIN activity ON user_id = c_custkey GROUP BY 1, 2""",
    "activity",
)
def _(spark, folder):
    return P.user_engagement(A.users(spark, folder), A.activity(spark, folder))


_ROLLUP = """SELECT platform, time_bucket(INTERVAL {0} SECOND, ts) AS time_bucket, CAST({0} AS BIGINT) AS bucket_seconds,
                    CAST(count(*) AS DOUBLE) AS volume, avg(engagement) AS engagement, avg(sign) AS sentiment
             FROM posts GROUP BY GROUPING SETS ((1, 2), (2))"""


@query(
    "F17_rollup_metrics",
    f"""SELECT * FROM ({_ROLLUP.format(3600)} UNION ALL {_ROLLUP.format(86400)})
        UNPIVOT (value FOR metric_name IN (volume, engagement, sentiment))""",
)
def _(spark, folder):
    return P.rollup_metrics(A.posts(spark, folder))


@query(
    "F18_average_sentiment",
    f"SELECT coalesce(avg(sign), 0.0) AS average_sentiment FROM posts WHERE {PAST_DAY}",
)
def _(spark, folder):
    return P.average_sentiment(A.posts(spark, folder))


_SCORED_TAGS = f"SELECT topic, count(*) AS mentions, avg(sign) AS score FROM tags WHERE {PAST_DAY} GROUP BY 1"


@query(
    "F18_polar_topics",
    f"""(SELECT 'positive' AS kind, * FROM ({_SCORED_TAGS}) WHERE score > 0 ORDER BY score DESC, mentions DESC, topic LIMIT 5)
        UNION ALL
        (SELECT 'negative' AS kind, * FROM ({_SCORED_TAGS}) WHERE score < 0 ORDER BY score, mentions DESC, topic LIMIT 5)""",
    "tags",
)
def _(spark, folder):
    return P.polar_topics(A.posts(spark, folder))


@query(
    "F19_analytics_report",
    f"""SELECT platform, 'sentiment' AS metric, avg(sign) AS value FROM posts WHERE {PAST_DAY} GROUP BY 1
        UNION ALL SELECT platform, 'volume', CAST(count(*) AS DOUBLE) FROM posts WHERE {PAST_DAY} GROUP BY 1
        UNION ALL SELECT platform, 'engagement', avg(engagement) FROM posts WHERE {PAST_DAY} GROUP BY 1
        UNION ALL SELECT platform, 'trending', CAST(count(DISTINCT topic) AS DOUBLE) FROM tags WHERE {PAST_DAY} GROUP BY 1""",
    "tags",
)
def _(spark, folder):
    return P.analytics_report(A.posts(spark, folder), ["sentiment", "volume", "engagement", "trending"])


@query(
    "F20_top_hashtags_by_platform",
    f"""SELECT platform, topic AS hashtag, count(*) AS count,
               CAST(row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, topic) AS INT) AS rank
        FROM tags WHERE {PAST_DAY} GROUP BY platform, topic QUALIFY rank <= 5""",
    "tags",
)
def _(spark, folder):
    return P.top_hashtags_by_platform(A.posts(spark, folder))
