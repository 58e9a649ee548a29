"""Row filters. Bounds are literals, so they reach the Parquet scan."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = "timestamp"
DATE = "ts_date"


def latest(df: DataFrame, column: str = TIME) -> str | None:
    """Newest time in `df`, the only value brought to the driver. Pass `as_of` to skip the scan."""
    return df.agg(F.max(column).cast("string")).first()[0]


def as_of_literal(df: DataFrame, as_of: datetime | str | None = None, column: str = TIME) -> Column:
    """`as_of` as a literal of the time column's own type, so that no cast blocks pushdown."""
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        as_of = latest(df, column)
    elif isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast(df.schema[column].dataType)


def not_before(df: DataFrame, bound: Column, column: str = TIME) -> DataFrame:
    """Rows at or after `bound`. Stored tables are also filtered by their day folders."""
    if DATE in df.columns:
        df = df.filter(F.col(DATE) >= bound.cast("date"))
    return df.filter(F.col(column) >= bound)


def since(df: DataFrame, as_of, span: str, column: str = TIME) -> DataFrame:
    """Rows no older than `span` before `as_of`; the bound itself is kept."""
    return not_before(df, as_of_literal(df, as_of, column) - F.expr(f"INTERVAL {span}"), column)


def last_hours(df: DataFrame, hours: int = 24, as_of=None, column: str = TIME) -> DataFrame:
    return since(df, as_of, f"{int(hours)} HOURS", column)


def today(df: DataFrame, as_of=None, column: str = TIME) -> DataFrame:
    midnight = as_of_literal(df, as_of, column).cast("date").cast(df.schema[column].dataType)
    return not_before(df, midnight, column)


def for_platform(df: DataFrame, platform: str | None = None) -> DataFrame:
    return df if platform in (None, "all") else df.filter(F.col("platform") == platform)


def processed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("processed_at").isNotNull())


def with_sentiment(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sentiment").isNotNull())


def has_hashtags(df: DataFrame) -> DataFrame:
    return df.filter(F.size("hashtags") > 0)


def about_topic(df: DataFrame, topic: str | None = None) -> DataFrame:
    return df if topic is None else df.filter(F.array_contains("hashtags", topic))


def posts_with(df: DataFrame, column: str, values: list[str], match_all: bool = False) -> DataFrame:
    """Rows whose array holds any (or all) of `values`."""
    if match_all:
        for value in values:
            df = df.filter(F.array_contains(column, value))
        return df
    return df.filter(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))))
