"""Queries for stored-table changes and request-log statistics."""

from pyspark.sql import functions as F

from pulse.operators import activity as I
from pulse.operators import limits as L
from pulse.operators import posts as P
from pulse.operators import tables as T
from pulse.operators import trending as G
from pulse.plans.post_queries import TODAY_SQL
from pulse.plans.registry import query
from pulse.session import new_folder
from pulse.sources import adapters as A
from pulse.sources.tables import read_table, write_table

KEYS = ["topic", "platform", "time_window"]


@query(
    "A01_read_table",
    """SELECT post_id, platform, ts AS timestamp, likes_count, array_to_string(hashtags, ',') AS hashtags,
              CAST(sentiment_confidence AS DOUBLE) AS confidence, CAST(ts AS DATE) AS ts_date FROM posts""",
)
def _(spark, folder):
    target = new_folder(spark, "tables")
    write_table(A.posts(spark, folder), "social_posts", target)
    return read_table(spark, "social_posts", target).select(
        "post_id", "platform", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "likes_count",
        F.array_join("hashtags", ",").alias("hashtags"),
        F.col("sentiment_confidence").cast("double").alias("confidence"), "ts_date",
    )


@query("A02_insert_new", "SELECT post_id, likes_count, ts AS timestamp FROM posts")
def _(spark, folder):
    """A week is stored; then all posts arrive, each also as a later copy with another count."""
    posts = A.posts(spark, folder).select("post_id", "likes_count", "timestamp")
    stored = T.apply_retention(posts, "social_posts", days=7)
    copies = posts.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).withColumn(
        "likes_count", F.col("likes_count") + 1
    )
    return T.insert_new(stored, posts.unionByName(copies), ["post_id"])


def _versions(spark, folder):
    old = G.build_trending(A.posts(spark, folder), 1).select(
        *KEYS, "mentions_count", F.lit("old").alias("related"), F.lit(None).cast("timestamp_ntz").alias("updated_at")
    )
    again = old.filter(F.col("platform") == "twitter")
    later = old.filter(F.col("platform") == "reddit").withColumn(
        "time_window", F.col("time_window") + F.expr("INTERVAL 60 DAYS")
    )
    batch = again.unionByName(later).withColumn("mentions_count", F.col("mentions_count") * 10)
    return old, batch.withColumn("related", F.lit("new"))


_UPSERT = """
    SELECT topic, platform, time_window, 'old' AS related,
           CASE WHEN platform = 'twitter' THEN mentions_count * 10 ELSE mentions_count END AS mentions_count{0} FROM trending
    UNION ALL
    SELECT topic, platform, time_window + INTERVAL 60 DAY, 'new', mentions_count * 10{1} FROM trending WHERE platform = 'reddit'"""


@query("A03_upsert", _UPSERT.format("", ""), "trending")
def _(spark, folder):
    old, batch = _versions(spark, folder)
    return T.upsert(old, batch, KEYS, ["mentions_count"]).drop("updated_at")


@query(
    "A04_change_stamp",
    _UPSERT.format(
        ", CASE WHEN platform = 'twitter' THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at", ", NULL"
    ),
    "trending",
)
def _(spark, folder):
    old, batch = _versions(spark, folder)
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return T.upsert(old, batch, KEYS, ["mentions_count"], stamp)


@query(
    "A05_json_columns",
    """SELECT post_id, concat('{"likes":', likes_count, ',"shares":', shares_count, '}') AS counts, likes_count AS likes
       FROM posts""",
)
def _(spark, folder):
    counts = F.create_map(F.lit("likes"), "likes_count", F.lit("shares"), "shares_count")
    stored = T.encode_json(A.posts(spark, folder).select("post_id", counts.alias("counts")), ["counts"])
    read = T.decode_json(stored.withColumn("map", F.col("counts")), {"map": "map<string,int>"})
    return read.select("post_id", "counts", F.col("map")["likes"].alias("likes"))


@query(
    "A06_retention",
    """SELECT event_type AS service_name, ts AS timestamp, value FROM events WHERE ts >= {now} - INTERVAL 7 DAY""",
    "",
)
def _(spark, folder):
    kept = T.apply_retention(A.service_log(spark, folder), "system_metrics")
    return kept.select("service_name", "timestamp", F.col("value").cast("double").alias("value"))


_SNAPSHOT = (
    "struct<posts_today:bigint,active_users:bigint,positive_count:bigint,negative_count:bigint,"
    "neutral_count:bigint,trending_topics:bigint>"
)


def _snapshot(spark, folder, read_at):
    target = new_folder(spark, "snapshot")
    T.publish_snapshot(P.today_stats(A.posts(spark, folder)), target, "2024-01-30 23:59:00")
    return T.read_snapshot(spark, target, read_at, _SNAPSHOT)


@query("A07_publish_snapshot", TODAY_SQL, "tags")
def _(spark, folder):
    return _snapshot(spark, folder, "2024-01-30 23:59:30")


@query(
    "A08_expired_snapshot",
    f"SELECT COLUMNS(*) * 0 FROM ({TODAY_SQL})",
    "tags",
)
def _(spark, folder):
    return _snapshot(spark, folder, "2024-01-31 00:01:00")


@query(
    "A09_cascade_delete",
    """SELECT id, user_id FROM activity
       WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
    "activity",
)
def _(spark, folder):
    left = spark.read.parquet(f"{folder}/customer.parquet").filter("c_mktsegment <> 'BUILDING'")
    left = left.select(F.col("c_custkey").alias("user_id"))
    return T.cascade_delete(A.activity(spark, folder).select("id", "user_id"), left, "user_id")


# Request log


@query(
    "I01_user_stats",
    """SELECT c_custkey AS user_id, c_name AS username, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_requests,
              CAST(coalesce(sum(today), 0) AS BIGINT) AS requests_today,
              string_agg(endpoint, ',' ORDER BY n DESC, endpoint) FILTER (place <= 10) AS favorite_endpoints
       FROM customer LEFT JOIN
            (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, endpoint) AS place FROM
                 (SELECT user_id, endpoint, count(*) AS n, count(*) FILTER (ts >= date_trunc('day', {now})) AS today
                  FROM activity GROUP BY 1, 2)) ON user_id = c_custkey
       GROUP BY 1, 2""",
    "activity",
)
def _(spark, folder):
    stats = I.user_stats(A.activity(spark, folder), A.users(spark, folder))
    return stats.withColumn("favorite_endpoints", F.array_join("favorite_endpoints", ","))


@query("I02_client_stats", "SELECT * FROM clients", "clients")
def _(spark, folder):
    return I.client_stats(A.activity(spark, folder))


@query(
    "I03_global_stats",
    """SELECT 'total' AS section, 'total_clients' AS name, count(DISTINCT client_id) AS value FROM clients
       UNION ALL SELECT 'total', 'requests_per_minute', CAST(sum(requests_last_minute) AS BIGINT) FROM clients
       UNION ALL SELECT 'total', 'requests_per_hour', CAST(sum(requests_last_hour) AS BIGINT) FROM clients
       UNION ALL SELECT 'endpoint', endpoint, CAST(sum(requests_last_minute) AS BIGINT) FROM clients GROUP BY endpoint
       UNION ALL (SELECT 'client', client_id, CAST(sum(requests_last_minute) AS BIGINT) AS n FROM clients
                  GROUP BY client_id ORDER BY n DESC, client_id LIMIT 10)""",
    "clients",
)
def _(spark, folder):
    return I.global_stats(A.activity(spark, folder))


# One user makes about two requests a day, so the registered limits are small.
SMALL = {"anonymous": (1, 1, 3), "authenticated": (1, 2, 3), "admin": (2, 2, 4)}
SMALL_SPECIAL = {"/ml/sentiment": {"anonymous": (1, 1), "authenticated": (1, 1)}}

_EFFECTIVE = """SELECT *, 1 + CAST(user_type = 'admin' AS INT) AS limit_minute,
        CASE WHEN user_type = 'anonymous' OR (endpoint = '/ml/sentiment' AND user_type = 'authenticated') THEN 1 ELSE 2 END AS limit_hour,
        3 + CAST(user_type = 'admin' AS INT) AS limit_day
    FROM activity"""


@query(
    "I04_limit_pressure",
    f"""SELECT id, before_minute, before_hour, before_day,
               CASE WHEN before_minute >= limit_minute THEN 'minute' WHEN before_hour >= limit_hour THEN 'hour'
                    WHEN before_day >= limit_day THEN 'day' END AS reached,
               greatest(limit_minute - before_minute - 1, 0) AS remaining
        FROM (SELECT *, count(*) OVER (w RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) - 1 AS before_minute,
                     count(*) OVER (w RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS before_hour,
                     count(*) OVER (w RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS before_day
              FROM ({_EFFECTIVE}) WINDOW w AS (PARTITION BY client_id, endpoint ORDER BY epoch_us(ts)))""",
    "activity",
)
def _(spark, folder):
    limits = L.limits_table(spark, SMALL, SMALL_SPECIAL)
    return L.limit_pressure(A.activity(spark, folder), limits).select(
        "id", "before_minute", "before_hour", "before_day", "reached", "remaining"
    )


def _general(window):
    return f"CASE user_type " + " ".join(
        f"WHEN '{who}' THEN {ns[window]}" for who, ns in L.GENERAL_LIMITS.items()
    ) + " END"


def _effective(window):
    rows = [
        f"WHEN endpoint = '{e}' AND user_type = '{who}' THEN {ns[window]}"
        for e, types in L.ENDPOINT_LIMITS.items()
        for who, ns in types.items()
    ]
    return f"CAST(CASE {' '.join(rows)} ELSE {_general(window)} END AS BIGINT)"


@query(
    "I05_effective_limits",
    f"""SELECT id, user_type, endpoint, {_effective(0)} AS limit_minute, {_effective(1)} AS limit_hour,
               CAST({_general(2)} AS BIGINT) AS limit_day FROM activity""",
    "activity",
)
def _(spark, folder):
    found = L.effective_limits(A.activity(spark, folder), L.limits_table(spark))
    return found.select("id", "user_type", "endpoint", "limit_minute", "limit_hour", "limit_day")


@query("I06_replay_limits")
def _(spark, folder):
    limits = L.limits_table(spark, SMALL, SMALL_SPECIAL)
    return L.replay_limits(A.activity(spark, folder), limits)


@query(
    "I06_replay_default_limits",
    """SELECT id, client_id, endpoint, ts AS timestamp, true AS allowed, ts + INTERVAL 60 SECOND AS reset_time FROM activity""",
    "activity",
)
def _(spark, folder):
    """Under the default limits this log is never denied."""
    return L.replay_limits(A.activity(spark, folder), L.limits_table(spark)).drop("denied_window", "remaining")


@query(
    "I07_fixed_window_counts",
    " UNION ALL ".join(
        f"""SELECT client_id, endpoint, time_bucket(INTERVAL {s} SECOND, ts) AS window_start,
                   count(*) AS request_count, CAST({s} AS BIGINT) AS window_seconds FROM activity GROUP BY 1, 2, 3"""
        for s in (60, 3600, 86400)
    ),
    "activity",
)
def _(spark, folder):
    return I.fixed_window_counts(A.activity(spark, folder))


@query(
    "I08_model_performance",
    """SELECT activity_type AS model_name, endpoint AS operation, count(*) AS total_requests,
              avg(processing_time_ms) AS average_processing_time_ms,
              avg(CAST(response_status = 200 AS INT)) AS success_rate,
              avg(CAST(response_status <> 200 AS INT)) AS error_rate,
              count(*) FILTER (ts >= {now} - INTERVAL 24 HOUR) AS last_24h_requests
       FROM activity GROUP BY 1, 2""",
    "activity",
)
def _(spark, folder):
    return I.model_performance(A.model_log(spark, folder))


@query(
    "I09_service_metrics",
    """SELECT event_type AS service_name, 'value' AS metric_name, time_bucket(INTERVAL 1 HOUR, ts) AS bucket,
              arg_max(value, ts) AS latest,
              CAST(sum(CAST(value AS DECIMAL(15,4))) AS DOUBLE) / count(*) AS average, max(value) AS maximum
       FROM events GROUP BY 1, 2, 3""",
    "",
)
def _(spark, folder):
    return I.service_metrics(A.service_log(spark, folder))
