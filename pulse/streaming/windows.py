"""Windowed aggregates over a stream of posts. Event time must be a TIMESTAMP column."""

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse.functions.columns import count_sentiments, zero_if_null
from pulse.functions.filters import TIME
from pulse.functions.params import SENTIMENTS
from pulse.operators.tables import first_per_key
from pulse.streaming.ingest import batch_name


def stream_posts_per_hour(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per closed hour and platform (append mode).

    An hour is final once a post arrives `late` past its end. Posts later than
    that are dropped here; the batch `posts_per_hour` is the exact recount.
    """
    return (
        posts.withWatermark(TIME, late)
        .groupBy(F.window(TIME, "1 hour"), "platform")
        .agg(F.count("*").alias("post_count"), *count_sentiments())
        .withColumn("window", F.col("window.start"))
        .withColumnRenamed("window", "bucket")
    )


def _per_minute(posts: DataFrame, late: str | None) -> GroupedData:
    if late is not None:
        posts = posts.withWatermark(TIME, late)
    return posts.groupBy(F.window(TIME, "1 minute"))


def stream_ppm(posts: DataFrame, late: str | None = None) -> DataFrame:
    """Running counts per minute (update mode).

    Every post counts, however late it comes; the state is one row per minute seen.
    `late` bounds that state: posts more than `late` behind the newest post of earlier
    batches are then dropped, and a run over all posts without it is the exact recount.
    """
    return _per_minute(posts, late).agg(F.count("*").alias("posts")).select(F.col("window.start").alias("minute"), "posts")


def stream_last_hour(posts: DataFrame, late: str | None = None) -> DataFrame:
    """Per-minute parts of the last-hour stats (update mode), authors as a mergeable sketch.

    A sliding window would count each post in 60 windows; here it is counted
    once, and `last_hour_stats` adds up minutes. `late` is that of `stream_ppm`.
    """
    return (
        _per_minute(posts, late)
        .agg(
            F.count("*").alias("posts"),
            F.hll_sketch_agg("author").alias("authors"),
            F.sum("processing_time_ms").alias("ms"),
            F.count("processing_time_ms").alias("timed"),
            *count_sentiments(),
        )
        .withColumn("window", F.col("window.start"))
        .withColumnRenamed("window", "minute")
    )


def last_hour_stats(minutes: DataFrame, span: int = 60) -> DataFrame:
    """Stats of the `span` minutes before each minute's end; authors are counted approximately."""
    ends = F.expr(f"sequence(minute + INTERVAL 1 MINUTE, minute + INTERVAL {span} MINUTES, INTERVAL 1 MINUTE)")
    counts = [f"{s}_count" for s in SENTIMENTS]
    return (
        minutes.withColumn("window_end", F.explode(ends))
        .groupBy("window_end")
        .agg(
            F.sum("posts").alias("posts"),
            F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("active_users"),
            zero_if_null(F.try_divide(F.sum("ms").cast("double"), F.sum("timed"))).alias("avg_processing_time_ms"),
            *[F.sum(c).alias(c) for c in counts],
        )
    )


def stream_author_minutes(posts: DataFrame, late: str | None = None) -> DataFrame:
    """Minutes in which each author posts (update mode), for `sliding_active_users`; `late` is that of `stream_ppm`."""
    if late is not None:
        posts = posts.withWatermark(TIME, late)
    counts = posts.groupBy(F.window(TIME, "1 minute"), "author").agg(F.count("*").alias("posts"))
    return counts.select(F.col("window.start").alias("minute"), "author", "posts")


def sliding_active_users(seen: DataFrame, span: int = 60) -> DataFrame:
    """(window_end, active_users): exact distinct authors of the `span` minutes before each minute's end.

    `seen` has a row (minute, author) for each minute in which an author posts; repeated rows count
    once, and posts without an author or a time count for nobody. The windows that an author is in are intervals:
    each minute adds those after the last one that the minute before already gave. Starts and
    ends are summed per minute, then as a running total inside a day and over the days, so an author
    is never counted per window, and nothing wider than a day of minutes is in one task.
    """
    def minutes(n):
        return F.make_dt_interval(mins=F.lit(n))

    at = F.col("minute")
    seen = seen.filter(at.isNotNull()).select("minute", "author").distinct()
    before = F.lag("minute").over(Window.partitionBy("author").orderBy("minute"))
    first = F.greatest(at + minutes(1), before + minutes(span + 1))  # NULL without one before, which greatest() skips
    known = seen.filter("author IS NOT NULL").select(first.alias("start"), (at + minutes(span + 1)).alias("stop"))
    changes = known.select(
        F.inline(
            F.array(
                F.struct(F.col("start").alias("window_end"), F.lit(1).cast("long").alias("change")),
                F.struct(F.col("stop").alias("window_end"), F.lit(-1).cast("long").alias("change")),
            )
        )
    )
    ends = F.sequence(at + minutes(1), at + minutes(span), minutes(1))
    asked = seen.select("minute").distinct().select(F.explode(ends).alias("window_end")).distinct()
    steps = (
        changes.withColumn("asked", F.lit(False))
        .unionByName(asked.select("window_end", F.lit(0).cast("long").alias("change"), F.lit(True).alias("asked")))
        .groupBy("window_end")
        .agg(F.sum("change").alias("change"), F.max("asked").alias("asked"))
        .withColumn("_day", F.to_date("window_end"))
    )
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = steps.groupBy("_day").agg(F.sum("change").alias("total"))  # one row per day
    days = days.select("_day", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_day").orderBy("window_end")
    running = steps.withColumn("inside", F.sum("change").over(inside)).filter("asked")
    return running.join(F.broadcast(days), "_day").select(
        "window_end", (F.col("inside") + F.col("_carried")).alias("active_users")
    )


def append_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start an append-mode query into a Parquet folder."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def update_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start an update-mode query; each batch writes its changed rows under its stream's and its own number.

    A batch that runs again after a failure replaces its own folder. A stream with a new
    checkpoint leaves the rows of those before it in place; current_rows() takes the newest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch_name(batch.sparkSession, checkpoint, batch_id).rpartition("_")[0]
        rows = batch.withColumn("written_at", F.current_timestamp())
        rows.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_rows(spark, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every row that update-mode queries wrote to `path`."""
    rows = first_per_key(spark.read.parquet(path), keys, [F.desc("written_at"), F.desc("batch_id")])
    return rows.drop("stream", "batch_id", "written_at")
