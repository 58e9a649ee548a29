"""Request-log statistics per user, client, endpoint, model and service."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.columns import bucket, mean
from pulse.functions.filters import TIME, as_of_literal, not_before

# The windows requests are counted in, in seconds.
WINDOWS = {"minute": 60, "hour": 3600, "day": 86400}


def user_stats(activity: DataFrame, users: DataFrame, as_of=None, top: int = 10) -> DataFrame:
    """Totals, requests today and the most used endpoints of every user."""
    now = as_of_literal(activity, as_of)
    midnight = now.cast("date").cast(activity.schema[TIME].dataType)
    per_endpoint = activity.groupBy("user_id", "endpoint").agg(
        F.count("*").alias("requests"), F.count_if(F.col(TIME) >= midnight).alias("today")
    )
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("requests"), "endpoint"))
    best = F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "endpoint")))
    per_user = (
        per_endpoint.withColumn("rank", rank)
        .groupBy("user_id")
        .agg(
            F.sum("requests").alias("total_requests"),
            F.sum("today").alias("requests_today"),
            F.sort_array(best)["endpoint"].alias("favorite_endpoints"),
        )
    )
    return (
        users.select("user_id", "username")
        .join(per_user, "user_id", "left")
        .na.fill(0, subset=["total_requests", "requests_today"])
    )


def client_stats(log: DataFrame, as_of=None) -> DataFrame:
    """Requests per client and endpoint in the last minute, hour and day; both ends count."""
    now = as_of_literal(log, as_of)
    longest = max(WINDOWS.values())
    recent = not_before(log, now - F.expr(f"INTERVAL {longest} SECONDS")).filter(F.col(TIME) <= now)
    return recent.groupBy("client_id", "endpoint").agg(
        *[
            F.count_if(F.col(TIME) >= now - F.expr(f"INTERVAL {seconds} SECONDS")).alias(
                f"requests_last_{name}"
            )
            for name, seconds in WINDOWS.items()
        ]
    )


def global_stats(log: DataFrame, as_of=None, top: int = 10) -> DataFrame:
    """Totals, endpoints by use in the last minute and the busiest clients, as (section, name, value)."""
    stats = client_stats(log, as_of)
    totals = stats.agg(
        F.countDistinct("client_id").alias("total_clients"),
        F.coalesce(F.sum("requests_last_minute"), F.lit(0)).alias("requests_per_minute"),
        F.coalesce(F.sum("requests_last_hour"), F.lit(0)).alias("requests_per_hour"),
    )
    rows = totals.unpivot([], totals.columns, "name", "value").withColumn("section", F.lit("total"))

    def by(column, section):
        used = stats.groupBy(F.col(column).alias("name"))
        return used.agg(F.sum("requests_last_minute").alias("value")).withColumn("section", F.lit(section))

    clients = by("client_id", "client").orderBy(F.desc("value"), "name").limit(top)
    return reduce(DataFrame.unionByName, [rows, by("endpoint", "endpoint"), clients])


def fixed_window_counts(log: DataFrame, sizes=(60, 3600, 86400)) -> DataFrame:
    """Requests per client, endpoint and fixed window of each size; the log is read once."""
    base = min(sizes)
    if any(size % base for size in sizes):
        raise ValueError("every window size must be a multiple of the smallest")
    small = log.groupBy("client_id", "endpoint", bucket(TIME, f"{base} seconds").alias("base")).agg(
        F.count("*").alias("n")
    )

    def of_size(size):
        start = bucket("base", f"{size} seconds").alias("window_start")
        counts = small.groupBy("client_id", "endpoint", start)
        return counts.agg(F.sum("n").alias("request_count")).withColumn(
            "window_seconds", F.lit(size).cast("long")
        )

    return reduce(DataFrame.unionByName, [of_size(size) for size in sizes])


def model_performance(log: DataFrame, as_of=None) -> DataFrame:
    day_ago = as_of_literal(log, as_of) - F.expr("INTERVAL 24 HOURS")
    return log.groupBy("model_name", "operation").agg(
        F.count("*").alias("total_requests"),
        mean("processing_time_ms").alias("average_processing_time_ms"),
        mean(F.col("success").cast("int")).alias("success_rate"),
        mean((~F.col("success")).cast("int")).alias("error_rate"),
        F.count_if(F.col(TIME) >= day_ago).alias("last_24h_requests"),
    )


def service_metrics(log: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Latest, mean and largest value per service, metric and bucket; equal times: the larger value."""
    return log.groupBy("service_name", "metric_name", bucket(TIME, interval).alias("bucket")).agg(
        F.max_by("value", F.struct(TIME, "value")).cast("double").alias("latest"),
        mean("value").alias("average"),
        F.max("value").cast("double").alias("maximum"),
    )
