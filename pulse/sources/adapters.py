"""Views that turn the benchmark tables into posts, users and request logs.

Every event is one post; the event whose id equals a document's id carries the
whole text of that document. Only `posts_with_text` reads the documents.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table in few files out to all cores.

    Spark plans splits by bytes, but a Parquet row group is never split, so
    few files may mean few busy tasks, however costly their texts are. A
    table with enough files or splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < 4 * cores and len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df


def _pick(index: Column, *values: str) -> Column:
    chosen = F.lit(values[-1])
    for position, value in enumerate(values[:-1]):
        chosen = F.when(index == position, value).otherwise(chosen)
    return chosen


def posts_of_events(events: DataFrame) -> DataFrame:
    """Posts without their text, from a batch or a stream of events."""
    k = F.col("k")
    tag = F.concat(F.lit("tag"), (k % 10).cast("string"))
    scored = F.col("event_type") != "error"
    return (
        # a generator, so that filters on what follows do not parse the JSON again
        events.select("*", F.json_tuple("props", "k").alias("k"))
        .withColumn("k", F.col("k").try_cast("int"))
        .withColumn("platform", _pick(F.col("event_id") % 3, "twitter", "reddit", "instagram"))
        .withColumn("likes_count", F.floor(F.col("value") * 4).cast("int"))
        .select(
            F.concat_ws("_", "platform", F.col("event_id").cast("string")).alias("post_id"),
            "platform",
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"),
            F.col("ts").alias("timestamp"),
            "likes_count",
            F.when(F.col("platform") == "twitter", F.floor(F.col("likes_count") / 3).cast("int"))
            .otherwise(0)
            .alias("shares_count"),
            F.floor(F.col("likes_count") / 5).cast("int").alias("comments_count"),
            F.when(k % 5 == 0, F.array().cast("array<string>"))
            .when(k % 5 < 3, F.array(tag))
            .otherwise(F.array(tag, "event_type"))
            .alias("hashtags"),
            F.array(F.concat(F.lit("user_"), k.cast("string"))).alias("mentions"),
            F.when(scored & (F.col("value") >= 60), "positive")
            .when(scored & (F.col("value") < 20), "negative")
            .when(scored, "neutral")
            .alias("sentiment"),
            F.when(scored, ((k % 50 + 50) / 100).cast("decimal(5,4)")).alias("sentiment_confidence"),
            F.when(scored, F.col("ts")).alias("processed_at"),
            F.when(scored, k).alias("processing_time_ms"),
            # what the text is made of, see posts_with_text
            "event_id",
            "value",
            "k",
        )
    )


_OWN = ("event_id", "value", "k")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return posts_of_events(_load(spark, folder, "events")).drop(*_OWN)


def add_text(bare: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach `content` and `language`: the document of the same id, then a composed line."""
    k = F.col("k")
    word = F.when(F.col("value") >= 60, "great").when(F.col("value") < 20, "broken").otherwise("usual")
    phrase = _pick(
        k % 5,
        "Acme Corp raised $1250.50",
        "from New York on 2024-03-01",
        "about the Open Data Summit",
        "with Jane Doe",
        "on a Nova Phone",
    )
    line = F.concat(
        word, F.lit(" "), phrase, F.lit(" #tag"), (k % 10).cast("string"), F.lit("! @user_"),
        k.cast("string"), F.lit(" #über_"), (k % 3).cast("string"), F.lit(" http://example.org/"),
        k.cast("string"), F.lit("?x=1#f"),
    )
    bodies = documents.select(F.col("doc_id").alias("event_id"), "text", "lang")
    return (
        bare.join(bodies, "event_id", "left")
        .withColumn("content", F.concat(F.coalesce(F.concat("text", F.lit("\n")), F.lit("")), line))
        .withColumn("language", F.coalesce("lang", F.lit("en")))
        .drop("text", "lang", *_OWN)
    )


def posts_with_text(spark: SparkSession, folder: str) -> DataFrame:
    return add_text(posts_of_events(spread(_load(spark, folder, "events"))), documents(spark, folder))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_load(spark, folder, "documents"))


def events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events files as a stream, with event time as `timestamp` so it can carry a watermark."""
    layout = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return (
        spark.readStream.schema(layout)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/events.parquet*")  # a pattern may name one file or a folder of files
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return _load(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat("c_name", F.lit("@example.org")).alias("email"),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    return _load(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("activity_type"),
        F.concat(F.lit("client_"), F.col("user_id").cast("string")).alias("client_id"),
        F.when(F.col("user_id") == 0, "admin")
        .when(F.col("user_id") % 2 == 1, "authenticated")
        .otherwise("anonymous")
        .alias("user_type"),
        _pick(
            F.col("event_id") % 4,
            "/ml/sentiment",
            "/ml/extract-entities",
            "/analytics/trending",
            "/analytics/metrics",
        ).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("response_status"),
        F.floor(F.col("value") * 10).cast("int").alias("processing_time_ms"),
        F.col("ts").alias("timestamp"),
    )


def model_log(spark: SparkSession, folder: str) -> DataFrame:
    return activity(spark, folder).select(
        F.col("activity_type").alias("model_name"),
        F.col("endpoint").alias("operation"),
        "processing_time_ms",
        (F.col("response_status") == 200).alias("success"),
        "timestamp",
    )


def service_log(spark: SparkSession, folder: str) -> DataFrame:
    return _load(spark, folder, "events").select(
        F.col("event_type").alias("service_name"),
        F.lit("value").alias("metric_name"),
        F.col("value").cast("decimal(15,4)").alias("value"),
        F.col("ts").alias("timestamp"),
    )
