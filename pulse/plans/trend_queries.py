"""Queries for trending topics, ranking and derived analytics."""

from pyspark.sql import functions as F

from pulse.functions.filters import latest
from pulse.operators import derived as D
from pulse.operators import posts as P
from pulse.operators import ranking as R
from pulse.operators import trending as G
from pulse.plans.post_queries import METRICS_SQL, PAST_DAY
from pulse.plans.registry import query
from pulse.session import new_folder
from pulse.sources import adapters as A


def trending(spark, folder):
    return G.build_trending(A.posts(spark, folder), 1)


def top_topics(spark, folder, **options):
    now = latest(A.posts(spark, folder))
    return G.trending_topics(trending(spark, folder), as_of=now, **options)


def as_doubles(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def detected(span: str, at_least: int) -> str:
    return f"""SELECT topic, platform, count(*) AS mentions_count,
                      CAST(CAST(round(avg(sign), 4) AS DECIMAL(5,4)) AS DOUBLE) AS sentiment_score,
                      date_trunc('hour', {{now}}) AS time_window
               FROM tags WHERE ts >= {{now}} - INTERVAL {span} GROUP BY topic, platform
               HAVING count(*) >= {at_least} ORDER BY mentions_count DESC, topic, platform LIMIT 20"""


@query("G01_detect_trending", detected("6 HOUR", 3), "tags")
def _(spark, folder):
    return as_doubles(G.detect_trending(A.posts(spark, folder), None, 6, 3), "sentiment_score")


@query("G02_trending_topics", "SELECT * FROM top_topics", "top_topics")
def _(spark, folder):
    topics = top_topics(spark, folder)
    return topics.withColumn("platforms", F.array_join("platforms", ","))


@query(
    "G03_daily_trending",
    """SELECT time_bucket(INTERVAL 1 DAY, time_window) AS day, platform, topic,
              CAST(sum(mentions_count) AS BIGINT) AS total_mentions,
              CAST(sum(sentiment_score) AS DOUBLE) / count(*) AS avg_sentiment,
              CAST(max(growth_rate) AS DOUBLE) AS peak_growth_rate
       FROM trending GROUP BY 1, 2, 3 HAVING sum(mentions_count) >= 10""",
    "trending",
)
def _(spark, folder):
    return G.daily_trending(trending(spark, folder))


@query(
    "G04_growth",
    """SELECT topic, platform, time_window, CAST(mentions_count AS BIGINT) AS mentions_count,
              CAST(growth_rate AS DOUBLE) AS growth_rate FROM trending""",
    "trending",
)
def _(spark, folder):
    rows = as_doubles(trending(spark, folder), "growth_rate")
    return rows.select("topic", "platform", "time_window", "mentions_count", "growth_rate")


@query(
    "G04_growth_of_all",
    """SELECT a.topic, a.platform, a.time_window, a.mentions_count, b.mentions_count AS mentions_before
       FROM hourly a LEFT JOIN hourly b ON b.topic = a.topic AND b.platform = a.platform
                                       AND b.time_window = a.time_window - INTERVAL 1 HOUR""",
    "hourly",
)
def _(spark, folder):
    """Every hashtag of every hour, none cut."""
    rows = G.build_trending(A.posts(spark, folder), 1, per_hour=None)
    return rows.select("topic", "platform", "time_window", "mentions_count", "mentions_before")


@query(
    "G05_trending_summary",
    """SELECT count(*) AS topics, CAST(sum(mentions) AS BIGINT) AS total_mentions,
              count(*) FILTER (sentiment_score > 0.1) AS positive_topics,
              CAST(sum(CAST(round(growth_rate, 4) AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_growth
       FROM top_topics""",
    "top_topics",
)
def _(spark, folder):
    return G.trending_summary(top_topics(spark, folder))


@query(
    "G06_build_trending",
    """SELECT topic, platform, time_window, mentions_count, CAST(sentiment_score AS DOUBLE) AS sentiment_score
       FROM trending""",
    "trending",
)
def _(spark, folder):
    rows = as_doubles(trending(spark, folder), "sentiment_score")
    return rows.select("topic", "platform", "time_window", "mentions_count", "sentiment_score")


@query(
    "H03_top_k",
    """SELECT post_id, engagement FROM posts ORDER BY engagement DESC, post_id LIMIT 50""",
)
def _(spark, folder):
    from pulse.functions.columns import engagement

    scored = A.posts(spark, folder).select("post_id", engagement().alias("engagement"))
    return R.top_k(scored, [F.desc("engagement"), "post_id"], 50)


@query(
    "H04_paginate",
    """SELECT post_id, ts AS timestamp, row_number() OVER (ORDER BY ts, post_id) AS row_number
       FROM posts QUALIFY row_number BETWEEN 41 AND 60""",
)
def _(spark, folder):
    rows = A.posts(spark, folder).select("post_id", "timestamp")
    return R.paginate(rows, ["timestamp", "post_id"], 3, 20)


@query(
    "H04_stored_page",
    """SELECT post_id, likes_count, row_number FROM (
           SELECT post_id, likes_count, row_number() OVER (ORDER BY likes_count DESC, platform, post_id DESC) AS row_number,
                  count(*) OVER () AS n FROM posts)
       WHERE (row_number - 1) // 20 = n // 2 // 20""",
)
def _(spark, folder):
    """The page in the middle, in mixed order, of a result stored in ranges of 500 rows."""
    rows, target = A.posts(spark, folder).select("post_id", "likes_count", "platform"), new_folder(spark, "pages")
    order = [F.desc("likes_count"), "platform", F.desc("post_id")]
    R.store_pages(rows, order, target, 500)
    return R.stored_page(spark, target, order, rows.count() // 2 // 20 + 1, 20).drop("platform")


@query(
    "H04_page_info",
    """SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size,
              CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 20.0) AS has_next,
              true AS has_previous
       FROM posts""",
)
def _(spark, folder):
    return R.page_info(A.posts(spark, folder), 3, 20)


@query(
    "H05_arg_top",
    f"""SELECT platform, total_posts FROM ({METRICS_SQL}) ORDER BY total_posts DESC, platform LIMIT 1""",
)
def _(spark, folder):
    metrics = P.platform_metrics(A.posts(spark, folder))
    return R.arg_top(metrics, [F.desc("total_posts"), "platform"]).select("platform", "total_posts")


@query(
    "J01_influencers",
    """SELECT author, platform, total_posts, avg_engagement, sentiment_impact,
              coalesce(round(engagement * 100.0 / nullif(sum(engagement) OVER (PARTITION BY platform), 0), 2), 0.0) AS reach_score
       FROM (SELECT author, platform, count(*) AS total_posts, sum(engagement) AS engagement,
                    coalesce(avg(engagement), 0.0) AS avg_engagement, avg(sign) AS sentiment_impact
             FROM posts GROUP BY 1, 2)""",
)
def _(spark, folder):
    return D.influencers(A.posts(spark, folder))


@query(
    "J02_related_tags",
    """SELECT topic, related, together,
              CAST(row_number() OVER (PARTITION BY topic ORDER BY together DESC, related) AS INT) AS rank
       FROM (SELECT a.topic, b.topic AS related, count(*) AS together
             FROM tags a JOIN tags b ON a.post_id = b.post_id AND a.topic <> b.topic GROUP BY 1, 2)
       QUALIFY rank <= 5""",
    "tags",
)
def _(spark, folder):
    return G.related_tags(A.posts(spark, folder))


@query(
    "J02_trending_with_related",
    """SELECT topic, platform, time_window, related_keywords FROM trending LEFT JOIN (
           SELECT topic, string_agg(related, ',' ORDER BY rank) AS related_keywords FROM (
               SELECT topic, related, row_number() OVER (PARTITION BY topic ORDER BY together DESC, related) AS rank
               FROM (SELECT a.topic, b.topic AS related, count(*) AS together
                     FROM tags a JOIN tags b ON a.post_id = b.post_id AND a.topic <> b.topic GROUP BY 1, 2)
               QUALIFY rank <= 5) GROUP BY topic) USING (topic)""",
    "tags trending",
)
def _(spark, folder):
    posts = A.posts(spark, folder)
    rows = G.with_related(G.build_trending(posts, 1), posts)
    return rows.select("topic", "platform", "time_window", F.array_join("related_keywords", ",").alias("related_keywords"))


@query(
    "J03_viral_posts",
    """SELECT post_id, platform, author, content_preview, engagement_score, viral_coefficient, peak_time, sentiment
       FROM (SELECT post_id, platform, author, sentiment, engagement AS engagement_score,
                    CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '...' ELSE content END AS content_preview,
                    engagement / avg(engagement) OVER (PARTITION BY platform) AS viral_coefficient,
                    date_trunc('hour', ts) AS peak_time
             FROM posts_text)
       ORDER BY viral_coefficient DESC, post_id LIMIT 20""",
    "posts_text",
)
def _(spark, folder):
    return D.viral_posts(A.posts_with_text(spark, folder))


@query(
    "J04_compare_platforms",
    f"""SELECT metric, max(platform) FILTER (rank = 1) AS winner,
               string_agg(platform || '=' || CAST(round(value * 1000) AS BIGINT), ',' ORDER BY platform) AS platforms,
               (max(value) FILTER (rank = 1) - max(value) FILTER (rank = 2)) * 100.0
                   / nullif(max(value) FILTER (rank = 2), 0) AS difference_percentage
        FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, platform) AS rank
              FROM (SELECT platform, CAST(total_posts AS DOUBLE) AS total_posts, CAST(unique_users AS DOUBLE) AS unique_users,
                           avg_engagement, CAST(positive_count AS DOUBLE) AS positive_count,
                           CAST(negative_count AS DOUBLE) AS negative_count, CAST(neutral_count AS DOUBLE) AS neutral_count
                    FROM ({METRICS_SQL}))
              UNPIVOT (value FOR metric IN (total_posts, unique_users, avg_engagement, positive_count, negative_count, neutral_count)))
        GROUP BY metric""",
)
def _(spark, folder):
    compared = D.compare_platforms(P.platform_metrics(A.posts(spark, folder)))
    thousandths = F.transform(
        F.array_sort(F.map_entries("platforms")),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string")),
    )
    return compared.withColumn("platforms", F.array_join(thousandths, ","))


@query(
    "J05_trend_analysis",
    """SELECT topic, platform, time_window, CAST(growth_rate AS DOUBLE) AS growth_rate, velocity,
              CASE WHEN growth_rate > 1.2 THEN 'Rising' WHEN growth_rate > 0.8 THEN 'Stable' ELSE 'Falling' END AS trend_direction
       FROM trending WHERE growth_rate IS NOT NULL""",
    "trending",
)
def _(spark, folder):
    return as_doubles(G.trend_analysis(trending(spark, folder)), "growth_rate")


@query(
    "J07_mention_edges",
    """SELECT author, mentioned, count(*) AS weight
       FROM (SELECT author, unnest(mentions) AS mentioned FROM posts) GROUP BY 1, 2""",
)
def _(spark, folder):
    return D.mention_graph(A.posts(spark, folder))


@query(
    "J07_mention_degrees",
    """SELECT mentioned, count(DISTINCT author) AS in_degree, count(*) AS mentions
       FROM (SELECT author, unnest(mentions) AS mentioned FROM posts) GROUP BY 1""",
)
def _(spark, folder):
    return D.mention_degrees(D.mention_graph(A.posts(spark, folder)))


INSIGHTS_SQL = f"""
    SELECT CAST(1 AS INT) AS position, 'trending_topics' AS source,
           concat('''', topic, ''' is trending with ', mentions, ' mentions') AS insight,
           (SELECT count(*) FROM (SELECT * FROM top_topics LIMIT 5)) AS source_rows
    FROM (SELECT * FROM top_topics ORDER BY mentions DESC, sentiment_score DESC, topic LIMIT 1)
    UNION ALL
    SELECT 2, 'sentiment_posts', concat(CAST(percentage AS DECIMAL(5,1)), '% of posts are ', sentiment), CAST(known AS BIGINT)
    FROM (SELECT sentiment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage,
                 sum(count(*)) OVER () AS known
          FROM posts WHERE {PAST_DAY} AND sentiment IS NOT NULL GROUP BY 1 ORDER BY n DESC, sentiment LIMIT 1)
    UNION ALL
    SELECT 3, 'active_platforms', concat(platform, ' is the most active platform with ', total_posts, ' posts'), n
    FROM (SELECT *, count(*) OVER () AS n FROM ({METRICS_SQL}) ORDER BY total_posts DESC, platform LIMIT 1)"""


@query("J08_insights", INSIGHTS_SQL, "top_topics posts")
def _(spark, folder):
    posts = A.posts(spark, folder)
    return D.insights(posts, trending(spark, folder), as_of=latest(posts))
