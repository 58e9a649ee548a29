"""Data quality: row checks with reasons, and key constraints of whole tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions import params

# Longest text each job accepts.
MAX_SENTIMENT_TEXT = 5000
MAX_ENTITY_TEXT = 10000


def _checks(df: DataFrame, max_length: int):
    """(reason, condition that makes a row bad); only for columns the table has."""

    def outside(name, low, high):
        return (F.col(name) < low) | (F.col(name) > high)

    text = "content" if "content" in df.columns else "text"
    rules = [(name, f"missing_{name}", F.col(name).isNull()) for name in ("post_id", "author", "timestamp")]
    rules += [
        (text, "blank_text", F.length(F.trim(F.coalesce(text, F.lit("")))) == 0),
        (text, "long_text", F.length(text) > max_length),
        ("sentiment_confidence", "bad_confidence", outside("sentiment_confidence", 0, 1)),
        ("platform", "missing_platform", F.col("platform").isNull()),
        ("platform", "bad_platform", ~F.col("platform").isin(*params.PLATFORMS)),
        ("sentiment", "bad_sentiment", ~F.col("sentiment").isin(*params.SENTIMENTS)),
        ("language", "bad_language", ~F.col("language").isin(*params.LANGUAGES)),
    ]
    rules += [
        (name, f"negative_{name}", F.col(name) < 0)
        for name in ("likes_count", "shares_count", "comments_count", "retweets_count")
    ]
    if "sentiment_scores" in df.columns:
        bad = F.exists(F.map_values("sentiment_scores"), lambda v: (v < 0) | (v > 1))
        rules.append(("sentiment_scores", "bad_scores", bad))
    return [(reason, bad) for name, reason, bad in rules if name in df.columns]


def with_reason(df: DataFrame, max_length: int = MAX_SENTIMENT_TEXT) -> DataFrame:
    """Add `reason`: the names of the failed checks, empty for a good row."""
    failed = [F.when(bad, F.lit(reason)) for reason, bad in _checks(df, max_length)]
    return df.withColumn("reason", F.concat_ws(",", *failed))


def validate_posts(df: DataFrame, max_length: int = MAX_SENTIMENT_TEXT) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reason."""
    marked = with_reason(df, max_length)
    return marked.filter(F.col("reason") == "").drop("reason"), marked.filter(F.col("reason") != "")


def check_constraints(df: DataFrame, not_null=(), unique=(), foreign=()) -> DataFrame:
    """Violations per constraint: rows with a NULL, keys used twice, rows whose parent is missing.

    `unique` holds lists of columns, `foreign` holds (column, parent table, parent column).
    """
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"not_null({c})") for c in not_null])
    parts = [nulls.unpivot([], list(nulls.columns), "constraint_name", "violations")] if not_null else []
    for keys in unique:
        name = f"unique({','.join(keys)})"
        twice = df.dropna(subset=keys).groupBy(*keys).count().filter(F.col("count") > 1)
        parts.append(twice.agg(F.count("*").alias("violations")).withColumn("constraint_name", F.lit(name)))
    for column, parent, parent_column in foreign:
        # counted per value first: one missing parent may own very many rows
        used = df.groupBy(column).count().filter(F.col(column).isNotNull())
        known = parent.select(F.col(parent_column).alias(column)).distinct()
        orphans = used.join(known, column, "left_anti")
        parts.append(
            orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).withColumn(
                "constraint_name", F.lit(f"foreign({column})")
            )
        )
    return reduce(DataFrame.unionByName, parts)
