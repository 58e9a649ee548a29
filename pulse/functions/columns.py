"""Column expressions shared by the operators; all stay inside generated code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions import params


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def engagement() -> Column:
    return F.col("likes_count") + F.col("shares_count") + F.col("comments_count")


def sentiment_sign(c="sentiment") -> Column:
    return F.when(_col(c) == "positive", 1).when(_col(c) == "negative", -1).otherwise(0)


def zero_if_null(c) -> Column:
    return F.coalesce(_col(c).cast("double"), F.lit(0.0))


def pct(part, total) -> Column:
    share = F.round(_col(part) * 100.0 / F.nullif(_col(total), F.lit(0)), 2)
    return F.coalesce(share, F.lit(0.0))


def mean(c) -> Column:
    """Average as one division of an exact sum; for integers and decimals, in any row order."""
    return F.try_divide(F.sum(_col(c)).cast("double"), F.count(_col(c)))


def bucket(c, interval: str) -> Column:
    """Start of the fixed-size time bucket that holds `c`."""
    return F.window(_col(c), interval)["start"]


def hour_floor(c) -> Column:
    return bucket(c, "1 hour")


def iso(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")


def sentiment_label(c="sentiment_score") -> Column:
    return F.when(_col(c) > 0.1, "Positive").when(_col(c) < -0.1, "Negative").otherwise("Neutral")


def trend_direction(c="growth_rate") -> Column:
    return F.when(_col(c) > 1.2, "Rising").when(_col(c) > 0.8, "Stable").otherwise("Falling")


def growth_band(c="growth_rate") -> Column:
    return F.when(_col(c) > 1.5, "high").when(_col(c) > 1.0, "medium").otherwise("low")


def mood_label(positive_pct, negative_pct) -> Column:
    return (
        F.when(_col(positive_pct) > 50, "Predominantly positive")
        .when(_col(negative_pct) > 50, "Predominantly negative")
        .otherwise("Mixed sentiment")
    )


def normalise_label(c) -> Column:
    # Fixed values
    labels = {"label_2": "positive", "label_1": "neutral", "label_0": "negative"}
    low = F.lower(_col(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[low], low)


def top_label(scores) -> Column:
    """Best entry of a score map as (key, value); the first of equal scores wins."""
    return F.aggregate(
        F.map_entries(_col(scores)),
        F.lit(None).cast("struct<key:string,value:double>"),
        lambda best, entry: F.when(
            best.isNull() | (entry["value"] > best["value"]), entry
        ).otherwise(best),
    )


def preview(c, length: int = 100) -> Column:
    return F.when(
        F.length(_col(c)) > length, F.concat(F.substring(_col(c), 1, length), F.lit("..."))
    ).otherwise(_col(c))


def top_emotions(emotions="emotions", k: int = 8) -> Column:
    """The k best entries of a score map, best first; equal scores by name."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries(_col(emotions)),
            lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("emotion")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda e: F.struct(e["emotion"].alias("emotion"), (-e["order"]).alias("score")),
    )


def first_n(c, n: int) -> Column:
    return F.slice(_col(c), 1, n)


def count_sentiments() -> list[Column]:
    return [F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in params.SENTIMENTS]


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, subset=columns)


def fill_unscored(df: DataFrame) -> DataFrame:
    """Give posts the scorer could not handle the neutral defaults. Posts must carry all columns."""
    # Fixed values
    scores = {"positive": 0.33, "negative": 0.33, "neutral": 0.34}
    defaults = {
        "sentiment": F.lit("neutral"),
        "sentiment_confidence": F.lit(0.5),
        "sentiment_scores": F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]),
        "emotions": F.create_map(),
        "entities": F.array(),
        "topics": F.array(),
        "processing_time_ms": F.lit(0),
        "processed_at": F.col("timestamp"),
    }
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), value.cast(df.schema[name].dataType))
            for name, value in defaults.items()
            if name in df.columns
        }
    )


def explode_tags(df: DataFrame, column: str = "hashtags", alias: str = "topic") -> DataFrame:
    """One row per array element; rows with an empty or NULL array vanish."""
    return df.withColumn(alias, F.explode(column)).drop(column)
