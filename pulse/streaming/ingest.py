"""Micro-batch ingest: de-duplicate, enrich, store, refresh trending topics and stats."""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse import schemas
from pulse.functions.columns import fill_unscored
from pulse.functions.filters import TIME, as_of_literal, last_hours, latest
from pulse.functions.lookups import sized
from pulse.functions.params import SENTIMENTS
from pulse.operators import scoring
from pulse.operators.stored_views import refresh_views
from pulse.operators.tables import first_per_key, merge_into, publish_snapshot, stored_yet
from pulse.operators.text import ingest_tags
from pulse.operators.trending import detect_trending, with_growth_of, with_related
from pulse.session import cut_lineage, drop_shuffles, kept_partitions
from pulse.sources.tables import note_days, noting, shape

POSTS, TRENDING, STATS = "social_posts", "trending_topics", "realtime_stats"
#: Index of stored ids, and state of the day's statistics.
IDS, DAYS = "post_ids", "day_state"
ID_BUCKETS = 16
MAX_BROADCAST_IDS = 2_000_000
STATS_LAYOUT = (
    "struct<posts_today:bigint,active_users:bigint,positive_count:bigint,negative_count:bigint,"
    "neutral_count:bigint,trending_topics:bigint,last_updated:timestamp>"
)


@dataclass
class Scorers:
    """Lookup tables the enrichment uses."""

    lexicon: DataFrame
    emotions: DataFrame
    dictionary: DataFrame


def enrich(posts: DataFrame, scorers: Scorers) -> DataFrame:
    """Tags, sentiment, emotions, entities and topics; posts that get no score take the defaults."""
    if "hashtags" not in posts.columns:
        posts = ingest_tags(posts)
    mood = scoring.score_mood(posts, scorers.lexicon, scorers.emotions)
    names = ("positive", "negative", "neutral")
    scores = F.create_map(*[part for name in names for part in (F.lit(name), F.col(name))])
    mood = mood.withColumn("sentiment_scores", scores).drop(*names)
    known = ("sentiment", "sentiment_confidence", "sentiment_scores", "emotions", "processed_at")
    # Joined first: what a Python function gives out has no known partitions, and the join would shuffle it.
    joined = posts.drop(*known).join(mood, "post_id", "left")
    found = scoring.entity_topics(scoring.extract_entities(joined, scorers.dictionary)).drop("entity_count")
    return fill_unscored(shape(found.withColumn("processed_at", F.current_timestamp()), POSTS))


def stored_posts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.TABLES[POSTS].fields)
        + ", ts_date date, batch string"
    ).parquet(f"{folder}/{POSTS}")


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch, unlike that of any other stream: batch numbers begin anew with each checkpoint, whose own id Spark stores there."""
    stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    return f"{stream}_{batch_id}"


def id_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("post_id"), F.lit(buckets)).cast("int").alias("bucket")


def id_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("post_id string, bucket int, batch string").parquet(f"{folder}/{IDS}")


def write_ids(posts: DataFrame, folder: str, buckets: int = ID_BUCKETS) -> None:
    """Add the ids of `posts` (with `batch`) to the index: a folder for each bucket and batch, whose rows it replaces.

    Files have a Bloom filter of their ids. `buckets` must stay the same for a store.
    """
    rows = posts.select("post_id", id_bucket(buckets), "batch").hint("rebalance", F.col("bucket"))
    (
        rows.sortWithinPartitions("bucket", "post_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#post_id", "true")
        .partitionBy("bucket", "batch")
        .parquet(f"{folder}/{IDS}")
    )


def seen_ids(batch: DataFrame, name: str, folder: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """Ids of `batch` that other batches stored, whichever stream wrote them. Only the buckets that the batch hits are read."""
    spark = batch.sparkSession
    if not stored_yet(lambda: id_index(spark, folder)):
        if not stored_yet(lambda: stored_posts(spark, folder)):
            return batch.select("post_id").limit(0)
        write_ids(stored_posts(spark, folder), folder, buckets)  # a store from before it had an index
    hit = [bucket for bucket, in batch.select(id_bucket(buckets)).distinct().collect()]  # at most `buckets` numbers
    others = id_index(spark, folder).filter(F.col("bucket").isin(hit) & (F.col("batch") != name)).select("post_id")
    return others.join(sized(batch.select("post_id"), MAX_BROADCAST_IDS), "post_id", "left_semi")


def unseen(
    batch: DataFrame, name: str, folder: str, buckets: int = ID_BUCKETS, ids: DataFrame | None = None
) -> DataFrame:
    """Posts of `batch` that no other batch stored. `ids` has all their ids, where that costs less than to work out `batch` for them.

    The ids that were stored are written out first: Spark drops what is cached of a plan that reads a folder
    as soon as the folder is written, and `write_ids` writes the index while the batch is still in use.
    """
    seen = cut_lineage(seen_ids(batch if ids is None else ids, name, folder, buckets))
    return batch.join(seen, "post_id", "left_anti")


def store(posts: DataFrame, name: str, folder: str, buckets: int = ID_BUCKETS) -> None:
    """Write posts, their ids and their part of the day's state under the batch's own folders, so a repeated batch replaces itself."""
    dated = shape(posts, POSTS).withColumn("ts_date", F.to_date(TIME)).withColumn("batch", F.lit(name))
    noted, changed = noting(dated)
    (
        noted.hint("rebalance", F.col("ts_date"))
        .sortWithinPartitions("ts_date", TIME)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ts_date", "batch")
        .parquet(f"{folder}/{POSTS}")
    )
    write_ids(dated, folder, buckets)
    write_day_state(dated, folder)
    note_days(posts.sparkSession, POSTS, folder, changed())


def write_day_state(posts: DataFrame, folder: str) -> None:
    """Add what the day's statistics need of `posts` (with `ts_date` and `batch`) to the stored state.

    A row for each day, kind and value: the distinct authors and hashtags with their earliest
    post's time, and the number of posts by sentiment and minute.
    """
    minute = F.date_trunc("minute", TIME)
    day = ["ts_date", "batch"]
    authors = posts.groupBy(*day, F.col("author").alias("value")).agg(F.min(TIME).alias("first"), F.count("*").alias("n"))
    tags = posts.select(*day, F.explode("hashtags").alias("value"), TIME).groupBy(*day, "value")
    tags = tags.agg(F.min(TIME).alias("first"), F.count("*").alias("n"))
    counts = posts.groupBy(*day, F.col("sentiment").alias("value"), minute.alias("first")).agg(F.count("*").alias("n"))
    columns = [*day, "kind", "value", "first", "n"]
    parts = [(authors, "author"), (tags, "tag"), (counts, "posts")]
    rows = [df.withColumn("kind", F.lit(kind)).select(columns) for df, kind in parts]
    (
        rows[0].union(rows[1]).union(rows[2])
        .hint("rebalance", F.col("ts_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ts_date", "batch")
        .parquet(f"{folder}/{DAYS}")
    )


def day_stats(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """today_stats() of the stored posts up to `as_of`, to the minute, from the day's state alone."""
    now = F.lit(str(as_of)).cast("timestamp")
    state = spark.read.schema("kind string, value string, first timestamp, n long, ts_date date, batch string")
    state = state.parquet(f"{folder}/{DAYS}").filter((F.col("ts_date") == F.to_date(now)) & (F.col("first") <= now))
    # A value counts once, whatever number of batches brought it; posts add up.
    once = state.filter("kind != 'posts'").groupBy("kind", "value").agg(F.lit(1).cast("long").alias("n"))
    rows = once.union(state.filter("kind = 'posts'").select("kind", "value", "n"))
    known = F.col("value").isNotNull()

    def total(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    kind = F.col("kind")
    return rows.agg(
        total(kind == "posts").alias("posts_today"),
        total((kind == "author") & known).alias("active_users"),
        *[total((kind == "posts") & (F.col("value") == s)).alias(f"{s}_count") for s in SENTIMENTS],
        total((kind == "tag") & known).alias("trending_topics"),
    )


def _published(spark: SparkSession, folder: str) -> str | None:
    """Time of the last published stats."""
    path = f"{folder}/{STATS}"
    if not stored_yet(lambda: spark.read.parquet(path)):
        return None
    record = spark.read.schema("record string").parquet(path)
    return latest(record.select(F.from_json("record", STATS_LAYOUT)["last_updated"].alias("t")), "t")


def refresh_trending(posts: DataFrame, folder: str, as_of: str, hours: int = 1, min_mentions: int = 3) -> None:
    """Upsert the topics of the last hours with their growth and related keywords.

    Growth counts the posts of the hours right before, whether or not a topic was stored then.
    Only the days of these hours are read and rewritten in the trending table.
    """
    now = as_of_literal(posts, as_of)
    found = detect_trending(posts, now, hours, min_mentions).withColumn("created_at", now)
    grown = with_growth_of(found, posts, now, hours)
    fresh = shape(with_related(grown, last_hours(posts, hours, now)), TRENDING)
    merge_into(fresh, TRENDING, folder, ["mentions_count", "sentiment_score", "growth_rate"])


def ingest_stream(
    posts: DataFrame,
    folder: str,
    checkpoint: str,
    scorers: Scorers | None = None,
    trending: dict | None = None,
    trigger: dict | None = None,
    buckets: int = ID_BUCKETS,
    views: tuple = (),
) -> StreamingQuery:
    """Start the ingest of a stream of posts into `folder`.

    Every post is stored once, however late it comes and whichever stream brought it first: copies in a
    batch and copies of stored posts are found by their ids, in an index of `buckets` parts, and no
    watermark drops a row. Streams may follow each other into one store, each with a checkpoint of its own;
    two at a time may store a post twice. Posts dated
    after the clock's time are stored too, but do not move the time that statistics
    are made for. `scorers=None` stores posts as they come. `trending` holds the
    arguments of `refresh_trending`, None to skip. `views` names the stored views to
    refresh after each batch, on the days that it changed.
    """
    spark = posts.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty():
                return
            known = [latest(batch.filter(F.col(TIME) <= F.current_timestamp())), _published(spark, folder)]
            as_of = max((t for t in known if t is not None), default=None)
            name = batch_name(spark, checkpoint, batch_id)
            # Enrichment reads its input along several branches and writes are three: each is worked out once.
            # One shuffle by id serves the first rows, the stored ids and, as its partitions are kept, the joins of enrichment.
            fresh = unseen(first_per_key(batch, ["post_id"], [TIME]), name, folder, buckets, batch)
            with kept_partitions(batch.sparkSession):
                found = fresh.persist()
            try:
                # A step's rows are held until the next one has them, so that a disk holds the texts twice and not three times.
                found.count()
                batch.unpersist()
                if scorers:
                    found = enrich(fresh, scorers).persist()
                    found.count()
                    fresh.unpersist()
                store(found, name, folder, buckets)
            finally:
                found.unpersist()
                fresh.unpersist()
        finally:
            batch.unpersist()
        del batch, fresh, found
        drop_shuffles(spark)
        refresh_views(spark, folder, views)
        if as_of is None:  # only posts of the future so far
            return
        if trending is not None:
            # The hours of the topics and as many before, for their growth; the day prunes folders, the time row groups.
            begin = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {2 * trending.get('hours', 1) + 1} HOURS")
            recent = stored_posts(spark, folder).filter((F.col("ts_date") >= F.to_date(begin)) & (F.col(TIME) >= begin))
            refresh_trending(recent.filter(F.col(TIME) <= F.lit(as_of)), folder, as_of, **trending)
        publish_snapshot(day_stats(spark, folder, as_of), f"{folder}/{STATS}", as_of)

    return (
        posts.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
