"""Queries that run a stream over the events to its end and read what it wrote."""

from pyspark.sql import functions as F

from pulse.engine import Engine, register_functions, to_json_document
from pulse.functions import lexicons as LX
from pulse.functions.filters import latest
from pulse.operators import tables as T
from pulse.plans.post_queries import METRICS_SQL, REALTIME_SQL, TODAY_SQL, _COUNTS
from pulse.plans.registry import query
from pulse.plans.trend_queries import INSIGHTS_SQL, detected, trending
from pulse.session import new_folder
from pulse.sources import adapters as A
from pulse.sources.tables import read_table, write_table
from pulse.streaming import ingest as S
from pulse.streaming import windows as W


def _posts(spark, folder):
    return A.posts_of_events(A.events_stream(spark, folder)).drop("event_id", "value", "k")


def _posts_with_text(spark, folder):
    return A.add_text(A.posts_of_events(A.events_stream(spark, folder)), A.documents(spark, folder))


def _scorers(spark):
    return S.Scorers(LX.sentiment_lexicon(spark), LX.emotion_lexicon(spark), LX.entity_dictionary(spark))


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _ingested(spark, posts, **options):
    target = new_folder(spark, "ingest")
    S.ingest_stream(posts, target, new_folder(spark, "offsets"), **options).awaitTermination()
    return target


def _out_of_order(spark, folder, posts_of, **options):
    """Ingest the events in three batches: the newest ten days first, the oldest last.

    The later batches bring copies of a tenth of what came before, and event 0 is dated ten years ahead.
    """
    feed, target, offsets = (new_folder(spark, name) for name in ("feed", "ingest", "offsets"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    layout, day = events.schema, F.dayofmonth("ts")
    ahead = F.when(F.col("event_id") == 0, F.col("ts") + F.expr("INTERVAL 10 YEAR")).otherwise(F.col("ts"))
    events = events.withColumn("ts", ahead)
    for first, last in ((20, 31), (10, 20), (0, 10)):
        again = (day > last) & (F.col("event_id") % 10 == 0)
        events.filter(((day > first) & (day <= last)) | again).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(layout).parquet(feed)
        posts = A.posts_of_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))
        S.ingest_stream(posts_of(posts), target, offsets, **options).awaitTermination()
    return target


_AHEAD = "ts + CASE WHEN event_id = 0 THEN INTERVAL 10 YEAR ELSE INTERVAL 0 YEAR END AS timestamp"


@query(
    "K01_ingest_stream",
    f"""SELECT p.post_id, p.author, {_AHEAD}, s.sentiment FROM posts p JOIN scored s USING (post_id)""",
    "posts scored",
)
def _(spark, folder):
    documents = A.documents(spark, folder)
    target = _out_of_order(
        spark, folder, lambda posts: A.add_text(posts, documents),
        scorers=_scorers(spark), trending={"min_mentions": 1},
    )
    stored = S.stored_posts(spark, target).select("post_id", "author", "timestamp", "sentiment")
    return _ntz(stored, "timestamp")


@query("K02_drop_copies", f"SELECT post_id, {_AHEAD}, sentiment FROM posts")
def _(spark, folder):
    def twice(posts):
        bare = posts.drop("event_id", "value", "k")
        return bare.unionByName(bare)

    stored = S.stored_posts(spark, _out_of_order(spark, folder, twice)).select("post_id", "timestamp", "sentiment")
    return _ntz(stored, "timestamp")


@query("K02_second_stream", f"SELECT post_id, {_AHEAD}, sentiment FROM posts")
def _(spark, folder):
    """Two streams with checkpoints of their own fill one store; the second one brings the first half again and the rest."""
    events, target = spark.read.parquet(f"{folder}/events.parquet"), new_folder(spark, "ingest")
    ahead = F.when(F.col("event_id") == 0, F.col("ts") + F.expr("INTERVAL 10 YEAR")).otherwise(F.col("ts"))
    for part in (events.filter("event_id % 2 = 0"), events):
        feed, offsets = new_folder(spark, "feed"), new_folder(spark, "offsets")
        part.withColumn("ts", ahead).write.parquet(feed)
        stream = spark.readStream.schema(events.schema).parquet(feed)
        posts = A.posts_of_events(stream.withColumn("ts", F.col("ts").cast("timestamp"))).drop("event_id", "value", "k")
        S.ingest_stream(posts, target, offsets).awaitTermination()
    return _ntz(S.stored_posts(spark, target).select("post_id", "timestamp", "sentiment"), "timestamp")


@query(
    "A03_merge_into",
    """SELECT post_id, likes_count + CASE WHEN changed THEN 1 ELSE 0 END AS likes_count
       FROM (SELECT *, event_id % 10 = 0 AND dayofmonth(ts) <= 10 AS changed FROM posts)
       UNION ALL
       SELECT post_id || '_new', likes_count + 1 FROM posts WHERE event_id % 10 = 0 AND dayofmonth(ts) <= 10""",
)
def _(spark, folder):
    """A batch of ten days, sent twice, with changed posts and new ones."""
    posts, target = A.posts(spark, folder), new_folder(spark, "merged")
    write_table(posts, S.POSTS, target, mode="overwrite")
    chosen = posts.filter((F.split_part("post_id", F.lit("_"), F.lit(2)) % 10 == 0) & (F.dayofmonth("timestamp") <= 10))
    changed = chosen.withColumn("likes_count", F.col("likes_count") + 1)
    batch = changed.unionByName(changed.withColumn("post_id", F.concat("post_id", F.lit("_new"))))
    for _ in range(2):
        T.merge_into(batch, S.POSTS, target, ["likes_count"])
    return read_table(spark, S.POSTS, target).select("post_id", "likes_count")


@query(
    "A06_drop_expired",
    "SELECT post_id, ts AS timestamp FROM posts WHERE CAST(ts AS DATE) >= CAST({now} - INTERVAL 7 DAY AS DATE)",
)
def _(spark, folder):
    posts, target = A.posts(spark, folder), new_folder(spark, "kept")
    write_table(posts, S.POSTS, target, mode="overwrite")
    T.drop_expired(spark, S.POSTS, target, latest(posts), days=7)
    return _ntz(read_table(spark, S.POSTS, target).select("post_id", "timestamp"), "timestamp")


_CLOSED_HOURS = f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, platform, count(*) AS post_count, {_COUNTS}
    FROM posts GROUP BY 1, 2 HAVING bucket + INTERVAL 1 HOUR <= {{now}} - INTERVAL 1 HOUR"""


@query("K03_stream_posts_per_hour", _CLOSED_HOURS)
def _(spark, folder):
    target = new_folder(spark, "hours")
    hours = W.stream_posts_per_hour(_posts(spark, folder))
    W.append_to(hours, target, new_folder(spark, "offsets")).awaitTermination()
    return _ntz(spark.read.schema(hours.schema).parquet(target), "bucket")


@query("K09_late_posts", _CLOSED_HOURS)
def _(spark, folder):
    """All events arrive once in time and, after the stream resumes, once more a day late."""
    feed, target, offsets = (new_folder(spark, name) for name in ("feed", "hours", "offsets"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    late = events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    for arriving in (events, late):
        arriving.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(events.schema).parquet(feed)
        posts = A.posts_of_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))
        hours = W.stream_posts_per_hour(posts)
        W.append_to(hours, target, offsets).awaitTermination()
    return _ntz(spark.read.schema(hours.schema).parquet(target), "bucket")


@query(
    "K04_stream_ppm",
    "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS posts FROM posts GROUP BY 1",
)
def _(spark, folder):
    target = new_folder(spark, "minutes")
    W.update_to(W.stream_ppm(_posts(spark, folder)), target, new_folder(spark, "offsets")).awaitTermination()
    return _ntz(W.current_rows(spark, target, ["minute"]), "minute")


@query(
    "K05_stream_last_hour",
    f"""SELECT window_end, count(*) AS posts, coalesce(avg(processing_time_ms), 0.0) AS avg_processing_time_ms, {_COUNTS}
        FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE * unnest(range(1, 61)) AS window_end
              FROM posts) GROUP BY 1""",
)
def _(spark, folder):
    """Authors are counted approximately, so that column is left out here."""
    target = new_folder(spark, "minutes")
    W.update_to(W.stream_last_hour(_posts(spark, folder)), target, new_folder(spark, "offsets")).awaitTermination()
    rows = W.last_hour_stats(W.current_rows(spark, target, ["minute"])).drop("active_users")
    return _ntz(rows, "window_end")


@query(
    "K05_active_users",
    """SELECT window_end, count(DISTINCT author) AS active_users
       FROM (SELECT author, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE * unnest(range(1, 61)) AS window_end
             FROM posts) GROUP BY 1""",
)
def _(spark, folder):
    """Exact authors of each sliding hour, from the minutes that a stream saw them in."""
    target = new_folder(spark, "authors")
    W.update_to(W.stream_author_minutes(_posts(spark, folder)), target, new_folder(spark, "offsets")).awaitTermination()
    return _ntz(W.sliding_active_users(W.current_rows(spark, target, ["minute", "author"])), "window_end")


@query("K06_stream_today", TODAY_SQL, "tags")
def _(spark, folder):
    target = _ingested(spark, _posts(spark, folder))
    stats = T.read_snapshot(spark, f"{target}/realtime_stats", "2024-01-01 00:00:00", S.STATS_LAYOUT)
    return stats.drop("last_updated")


@query("K07_stream_trending", detected("1 HOUR", 1), "tags")
def _(spark, folder):
    target = _ingested(spark, _posts(spark, folder), trending={"min_mentions": 1})
    rows = read_table(spark, "trending_topics", target).select(
        "topic", "platform", "mentions_count", F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "time_window",
    )
    return _ntz(rows, "time_window")


@query(
    "K08_stream_enrichment",
    """SELECT s.post_id, s.sentiment, string_agg(DISTINCT lower(text), ',' ORDER BY lower(text))
                  FILTER (label IN ('ORG', 'PRODUCT', 'EVENT', 'PERSON')) AS topics,
              count(e.label) AS n_entities
       FROM scored s LEFT JOIN entities e ON e.post_id = s.post_id GROUP BY 1, 2""",
    "scored entities",
)
def _(spark, folder):
    target = _ingested(spark, _posts_with_text(spark, folder), scorers=_scorers(spark))
    stored = S.stored_posts(spark, target)
    topics = F.nullif(F.array_join("topics", ","), F.lit(""))
    return stored.select(
        "post_id", "sentiment", topics.alias("topics"), F.size("entities").cast("long").alias("n_entities")
    )


def _views(spark, folder):
    A.posts(spark, folder).createOrReplaceTempView("social_posts")
    trending(spark, folder).createOrReplaceTempView("trending_topics")
    register_functions(spark)


@query("L01_get_trending_topics", "SELECT * FROM top_topics", "top_topics")
def _(spark, folder):
    _views(spark, folder)
    rows = spark.sql("SELECT * FROM get_trending_topics()")
    return rows.withColumn("platforms", F.array_join("platforms", ","))


@query(
    "L01_get_sentiment_distribution",
    """SELECT sentiment, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
       FROM posts WHERE ts >= {now} - INTERVAL 48 HOUR AND sentiment IS NOT NULL AND platform = 'twitter' GROUP BY 1""",
)
def _(spark, folder):
    _views(spark, folder)
    return spark.sql("SELECT * FROM get_sentiment_distribution('twitter', hours => 48)")


def _engine(spark, folder):
    return Engine(A.posts(spark, folder), trending(spark, folder))


@query("L02_engine_metrics", METRICS_SQL)
def _(spark, folder):
    return _engine(spark, folder).metrics()


@query("L02_engine_insights", INSIGHTS_SQL, "top_topics posts")
def _(spark, folder):
    return _engine(spark, folder).insights_summary(timeframe="24h")


@query(
    "L02_engine_realtime_stats",
    f"""SELECT r.*, m.posts_per_minute, m.trend, t.trending_topics_count
        FROM ({REALTIME_SQL}) r,
             (SELECT coalesce(avg(n), 0.0) AS posts_per_minute, string_agg(n, ',' ORDER BY minute DESC) AS trend FROM (
                  SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS n FROM posts
                  WHERE ts >= {{now}} - INTERVAL 10 MINUTE GROUP BY 1 ORDER BY minute DESC LIMIT 10)) m,
             (SELECT count(DISTINCT topic) AS trending_topics_count FROM trending
              WHERE time_window >= {{now}} - INTERVAL 1 HOUR) t""",
    "trending",
)
def _(spark, folder):
    stats = _engine(spark, folder).realtime_stats()
    return stats.withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


@query(
    "L02_engine_time_series",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, CAST(count(*) AS DOUBLE) AS value FROM posts
       WHERE ts >= {now} - INTERVAL 720 HOUR GROUP BY 1""",
)
def _(spark, folder):
    return _engine(spark, folder).time_series("post_volume", timeframe="30d")


@query(
    "L02_engine_documents",
    f"SELECT concat('{{\"data\":{{\"platform\":\"', platform, '\",\"total_posts\":', total_posts, '}}}}') AS document FROM ({METRICS_SQL})",
)
def _(spark, folder):
    return to_json_document(_engine(spark, folder).metrics().select("platform", "total_posts"))
