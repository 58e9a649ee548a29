"""Column layout of every stored table; reads never infer a schema."""

from pyspark.sql import types as T

_STR, _INT, _LONG, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TS, _DBL = T.TimestampType(), T.DoubleType()
_STRS = T.ArrayType(_STR)
_SCORES = T.MapType(_STR, _DBL)

ENTITIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", _STR),
            T.StructField("label", _STR),
            T.StructField("description", _STR),
            T.StructField("start", _INT),
            T.StructField("end", _INT),
            T.StructField("confidence", _DBL),
        ]
    )
)


def _struct(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TABLES = {
    "users": _struct(
        user_id=_STR, username=_STR, email=_STR, full_name=_STR, is_admin=_BOOL,
        is_active=_BOOL, created_at=_TS, last_login=_TS, updated_at=_TS,
    ),
    "social_posts": _struct(
        post_id=_STR, platform=_STR, author=_STR, content=_STR, timestamp=_TS, created_at=_TS,
        likes_count=_INT, shares_count=_INT, comments_count=_INT, retweets_count=_INT,
        hashtags=_STRS, mentions=_STRS, urls=_STRS, location=_STR, language=_STR,
        sentiment=_STR, sentiment_confidence=T.DecimalType(5, 4), sentiment_scores=_SCORES,
        emotions=_SCORES, entities=ENTITIES, topics=_STRS, processed_at=_TS,
        processing_time_ms=_INT,
    ),
    "trending_topics": _struct(
        topic=_STR, platform=_STR, mentions_count=_LONG, sentiment_score=T.DecimalType(5, 4),
        growth_rate=T.DecimalType(18, 4), related_keywords=_STRS, time_window=_TS, created_at=_TS,
    ),
    "user_activity": _struct(
        id=_LONG, user_id=_STR, activity_type=_STR, endpoint=_STR, request_data=_STR,
        response_status=_INT, processing_time_ms=_INT, ip_address=_STR, user_agent=_STR,
        timestamp=_TS,
    ),
    "analytics_aggregations": _struct(
        metric_name=_STR, platform=_STR, time_bucket=_TS, bucket_seconds=_LONG,
        value=T.DecimalType(15, 4), metadata=_STR,
    ),
    "system_metrics": _struct(
        service_name=_STR, metric_name=_STR, value=T.DecimalType(15, 4), tags=_STR, timestamp=_TS
    ),
    "rate_limits": _struct(
        client_id=_STR, endpoint=_STR, window_start=_TS, window_seconds=_LONG, request_count=_LONG
    ),
    "ml_model_performance": _struct(
        model_name=_STR, operation=_STR, input_length=_INT, processing_time_ms=_INT,
        success=_BOOL, error_message=_STR, confidence_score=T.DecimalType(5, 4), timestamp=_TS,
    ),
}

# Time column of each table: scans are pruned and old rows are dropped by it.
TIME_COLUMN = {
    "users": "created_at",
    "social_posts": "timestamp",
    "trending_topics": "time_window",
    "user_activity": "timestamp",
    "analytics_aggregations": "time_bucket",
    "system_metrics": "timestamp",
    "rate_limits": "window_start",
    "ml_model_performance": "timestamp",
}

# Columns that identify a row, used by insert, upsert and the constraint report.
KEYS = {
    "users": ["user_id"],
    "social_posts": ["post_id"],
    "trending_topics": ["topic", "platform", "time_window"],
    "user_activity": ["id"],
    "analytics_aggregations": ["metric_name", "platform", "time_bucket", "bucket_seconds"],
    "rate_limits": ["client_id", "endpoint", "window_start", "window_seconds"],
}

# Days a table keeps its rows.
RETENTION_DAYS = {
    "social_posts": 30,
    "user_activity": 90,
    "system_metrics": 7,
    "ml_model_performance": 30,
}
