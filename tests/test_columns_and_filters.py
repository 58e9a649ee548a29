from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulse.functions import columns as C
from pulse.functions import filters as B
from pulse.functions import params

POST = "post_id string, platform string, author string, timestamp timestamp_ntz, likes_count int, shares_count int, comments_count int, hashtags array<string>, sentiment string"


def post(spark, *rows):
    return spark.createDataFrame(rows, POST)


def at(h, m=0, s=0):
    return datetime(2024, 1, 2, h, m, s)


@pytest.fixture(scope="module")
def posts(spark):
    return post(
        spark,
        ("a", "twitter", "u1", at(10), 1, 2, 3, ["x"], "positive"),
        ("b", "reddit", "u1", at(11), 4, None, 6, [], None),
        ("c", "twitter", "u2", at(12), 0, 0, 0, None, "negative"),
    )


def ids(df):
    return sorted(r["post_id"] for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_window_bound_is_inclusive(posts):
    assert ids(B.last_hours(posts, 2, at(12))) == ["a", "b", "c"]
    assert ids(B.last_hours(posts, 2, datetime(2024, 1, 2, 12, 0, 0, 1))) == ["b", "c"]


def test_as_of_defaults_to_newest_and_has_no_upper_bound(posts):
    assert ids(B.last_hours(posts, 1)) == ["b", "c"]
    assert ids(B.last_hours(posts, 1, at(11))) == ["a", "b", "c"]


def test_window_reaches_the_scan(spark, folder):
    from pulse.sources import adapters

    plan = B.last_hours(adapters.posts(spark, folder), 1)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_platform_filter(posts):
    assert ids(B.for_platform(posts, None)) == ids(B.for_platform(posts, "all")) == ["a", "b", "c"]
    assert ids(B.for_platform(posts, "reddit")) == ["b"]


def test_empty_and_null_hashtags_are_dropped(posts):
    assert ids(B.has_hashtags(posts)) == ["a"]
    assert ids(C.explode_tags(posts)) == ["a"]


def test_empty_input(posts):
    assert B.last_hours(posts.limit(0), 1).count() == 0
    assert B.today(posts.limit(0)).count() == 0


def test_match_all(spark):
    df = post(spark, ("a", "p", "u", at(1), 0, 0, 0, ["x", "y"], None), ("b", "p", "u", at(1), 0, 0, 0, ["x"], None))
    assert ids(B.posts_with(df, "hashtags", ["x", "y"])) == ["a", "b"]
    assert ids(B.posts_with(df, "hashtags", ["x", "y"], match_all=True)) == ["a"]


def test_engagement_is_null_if_a_part_is(posts):
    assert [r[0] for r in posts.orderBy("post_id").select(C.engagement()).collect()] == [6, None, 0]


def test_sign_of_null_is_zero(posts):
    assert [r[0] for r in posts.orderBy("post_id").select(C.sentiment_sign()).collect()] == [1, 0, -1]


def test_pct_of_nothing_is_zero(spark):
    assert one(spark, C.pct(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, C.pct(F.lit(1), F.lit(3))) == 33.33


def test_top_label_keeps_the_first_of_equals(spark):
    scores = F.create_map(F.lit("b"), F.lit(0.4), F.lit("a"), F.lit(0.4), F.lit("c"), F.lit(0.2))
    assert tuple(one(spark, C.top_label(scores))) == ("b", 0.4)


def test_top_emotions_orders_by_score_then_name(spark):
    scores = F.create_map(F.lit("joy"), F.lit(0.2), F.lit("fear"), F.lit(0.6), F.lit("anger"), F.lit(0.2))
    assert [tuple(e) for e in one(spark, C.top_emotions(scores, 2))] == [("fear", 0.6), ("anger", 0.2)]


@pytest.mark.parametrize("length, wanted", [(100, 100), (101, 103)])
def test_preview(spark, length, wanted):
    assert len(one(spark, C.preview(F.lit("x" * length)))) == wanted


@pytest.mark.parametrize("raw, wanted", [("LABEL_2", "positive"), ("label_0", "negative"), ("Neutral", "neutral"), ("other", "other")])
def test_normalise_label(spark, raw, wanted):
    assert one(spark, C.normalise_label(F.lit(raw))) == wanted


@pytest.mark.parametrize(
    "score, label", [(0.1, "Neutral"), (0.11, "Positive"), (-0.1, "Neutral"), (-0.2, "Negative")]
)
def test_sentiment_label_bounds_are_open(spark, score, label):
    assert one(spark, C.sentiment_label(F.lit(score))) == label


@pytest.mark.parametrize(
    "growth, direction, band",
    [(1.2, "Stable", "medium"), (1.3, "Rising", "medium"), (0.8, "Falling", "low"), (1.6, "Rising", "high")],
)
def test_trend_labels(spark, growth, direction, band):
    assert one(spark, C.trend_direction(F.lit(growth))) == direction
    assert one(spark, C.growth_band(F.lit(growth))) == band


def test_params():
    assert params.resolve_hours(None, "30d") == 720
    assert params.resolve_hours() == 24
    assert [params.default_interval(h) for h in (6, 24, 25)] == ["15m", "1h", "6h"]
    for bad in (
        lambda: params.resolve_hours(0),
        lambda: params.resolve_hours(169),
        lambda: params.resolve_hours(timeframe="2h"),
        lambda: params.interval_text("2h"),
        lambda: params.all_of(["volume", "reach"], params.REPORT_METRICS, "metrics"),
        lambda: params.all_of([], params.REPORT_METRICS, "metrics"),
    ):
        with pytest.raises(ValueError):
            bad()
