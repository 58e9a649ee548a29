"""Call arguments: allowed values, checked on the driver before a plan is built."""

# Fixed values
PLATFORMS = ("twitter", "reddit", "instagram")
SENTIMENTS = ("positive", "negative", "neutral")
EMOTIONS = ("joy", "sadness", "anger", "fear", "surprise", "disgust", "love")
LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "nl", "ru", "zh", "ja", "ko", "ar")
SERIES_METRICS = ("post_volume", "sentiment_trend", "engagement", "user_activity")
REPORT_METRICS = ("sentiment", "volume", "engagement", "trending")
TEXT_OPERATIONS = ("sentiment", "emotions", "entities", "topics")
INTERVALS = {
    "5m": "5 minutes",
    "15m": "15 minutes",
    "1h": "1 hour",
    "6h": "6 hours",
    "1d": "1 day",
}
TIMEFRAME_HOURS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720}
MAX_HOURS = 168
MAX_LIMIT = 50
MAX_PAGE_SIZE = 100


def one_of(value: str, allowed, what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what}: {value}")
    return value


def all_of(values, allowed, what: str) -> list[str]:
    unknown = sorted(set(values) - set(allowed))
    if unknown or not values:
        raise ValueError(f"unknown {what}: {unknown}")
    return [v for v in allowed if v in values]


def between(value: int, low: int, high: int, what: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{what} must be {low} to {high}, got {value}")
    return value


def resolve_hours(hours: int | None = None, timeframe: str | None = None, default: int = 24) -> int:
    """Hours of look-back from either spelling; a named timeframe may exceed the hour limit."""
    if timeframe is not None:
        return TIMEFRAME_HOURS[one_of(timeframe, TIMEFRAME_HOURS, "timeframe")]
    return between(default if hours is None else hours, 1, MAX_HOURS, "hours")


def interval_text(interval: str) -> str:
    return INTERVALS[one_of(interval, INTERVALS, "interval")]


def default_interval(hours: int) -> str:
    return "15m" if hours <= 6 else "1h" if hours <= 24 else "6h"
