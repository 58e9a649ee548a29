"""Influencers, viral posts, platform comparison, mention network, insight sentences."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.columns import engagement, hour_floor, mean, pct, preview, sentiment_sign, zero_if_null
from pulse.functions.filters import latest
from pulse.operators import posts as P
from pulse.operators import trending as G

SALTS = 64


def join_few(many: DataFrame, few: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Join rows to a table with very few keys.

    Each key is split over SALTS tasks, so a platform that owns a third of all
    rows does not become one task. Spark turns the join into a broadcast when
    it measures `few` below its size threshold.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def influencers(posts: DataFrame) -> DataFrame:
    """Per author and platform: posts, mean engagement, mean signed sentiment, share of engagement."""
    authors = posts.groupBy("author", "platform").agg(
        F.count("*").alias("total_posts"),
        F.sum(engagement()).alias("engagement"),
        zero_if_null(mean(engagement())).alias("avg_engagement"),
        mean(sentiment_sign()).alias("sentiment_impact"),
    )
    platforms = posts.groupBy("platform").agg(F.sum(engagement()).alias("platform_engagement"))
    return join_few(authors, platforms, "platform", "author").select(
        "author", "platform", "total_posts", "avg_engagement", "sentiment_impact",
        pct("engagement", F.col("platform_engagement")).alias("reach_score"),
    )


def viral_posts(posts: DataFrame, k: int = 20) -> DataFrame:
    """Posts with the highest engagement relative to the mean of their platform.

    Inside a platform that order is the order of engagement, so the k best of
    each platform are enough; Spark cuts them per task before the shuffle.
    """
    scored = posts.withColumn("engagement_score", engagement())
    averages = posts.groupBy("platform").agg(mean(engagement()).alias("platform_avg"))
    rank = Window.partitionBy("platform").orderBy(F.desc("engagement_score"), "post_id")
    best = (
        scored.select(
            "post_id", "platform", "author", preview("content").alias("content_preview"),
            "sentiment", "timestamp", "engagement_score",
        )
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= k)
    )
    return (
        best.join(averages, "platform")
        .withColumn("viral_coefficient", F.try_divide("engagement_score", "platform_avg"))
        .orderBy(F.desc("viral_coefficient"), "post_id")
        .limit(k)
        .select(
            "post_id", "platform", "author", "content_preview",
            "engagement_score", "viral_coefficient", hour_floor("timestamp").alias("peak_time"),
            "sentiment",
        )
    )


def compare_platforms(metrics: DataFrame) -> DataFrame:
    """Per metric of `platform_metrics`: values, the platform with the largest, lead over the second."""
    columns = [c for c in metrics.columns if c != "platform"]
    rows = metrics.select("platform", *[F.col(c).cast("double").alias(c) for c in columns])
    long = rows.unpivot("platform", columns, "metric", "value")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "platform"))
    ranked = long.withColumn("rank", rank)
    first, second = (F.max(F.when(F.col("rank") == r, F.col("value"))) for r in (1, 2))
    return ranked.groupBy("metric").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "value")))).alias("platforms"),
        F.max(F.when(F.col("rank") == 1, F.col("platform"))).alias("winner"),
        F.try_divide((first - second) * 100.0, F.nullif(second, F.lit(0.0))).alias("difference_percentage"),
    )


def mention_graph(posts: DataFrame) -> DataFrame:
    """Weighted edges author to mentioned user."""
    edges = posts.select("author", F.explode("mentions").alias("mentioned"))
    return edges.groupBy("author", "mentioned").agg(F.count("*").alias("weight"))


def mention_degrees(edges: DataFrame) -> DataFrame:
    """How many authors mention a user, and how often."""
    return edges.groupBy("mentioned").agg(
        F.count("*").alias("in_degree"), F.sum("weight").alias("mentions")
    )


def insights(posts, trending, platform=None, hours=24, as_of=None) -> DataFrame:
    """Up to three sentences with the number of source rows behind each."""
    as_of = latest(posts) if as_of is None else as_of
    topics = G.trending_topics(trending, platform, hours, 5, as_of)
    shares = P.sentiment_distribution(posts, platform, hours, as_of)
    platforms = P.platform_metrics(posts, 24, as_of)

    def line(position, df, order, text, source, rows):
        """The sentence of the first row in `order`, none if `df` is empty."""
        best = df.agg(F.min_by(text, F.struct(*order)).alias("insight"), rows.cast("long").alias("source_rows"))
        return best.filter(F.col("insight").isNotNull()).select(
            F.lit(position).alias("position"), "insight", F.lit(source).alias("source"), "source_rows"
        )

    share = F.col("percentage").cast("decimal(5,1)").cast("string")
    return reduce(
        DataFrame.unionByName,
        [
            line(
                1, topics, [-F.col("mentions"), -F.col("sentiment_score"), F.col("topic")],
                F.format_string("'%s' is trending with %d mentions", "topic", "mentions"),
                "trending_topics", F.count("*"),
            ),
            line(
                2, shares, [-F.col("count"), F.col("sentiment")],
                F.format_string("%s%% of posts are %s", share, "sentiment"),
                "sentiment_posts", F.sum("count"),
            ),
            line(
                3, platforms, [-F.col("total_posts"), F.col("platform")],
                F.format_string("%s is the most active platform with %d posts", "platform", "total_posts"),
                "active_platforms", F.count("*"),
            ),
        ],
    )
