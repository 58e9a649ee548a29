from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulse.engine import Engine
from pulse.operators import derived as D
from pulse.operators import posts as P
from pulse.operators import ranking as R
from pulse.operators import trending as G
from pulse.session import new_folder
from pulse.sources import adapters as A

POST = "post_id string, platform string, author string, content string, timestamp timestamp_ntz, likes_count int, shares_count int, comments_count int, hashtags array<string>, mentions array<string>, sentiment string, processing_time_ms int"
NOON = datetime(2024, 1, 2, 12)


def make(spark, *rows):
    full = [
        (f"p{i}", r.get("platform", "twitter"), r.get("author", "u"), "text", r.get("at", NOON), r.get("likes", 0), 0, 0,
         r.get("tags", []), [], r.get("sentiment"), r.get("ms"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, POST)


def test_author_on_two_platforms_counts_on_each(spark):
    df = make(spark, dict(platform="twitter"), dict(platform="reddit"))
    assert P.platform_summary(P.platform_metrics(df)).first().asDict() == {
        "total_posts": 2, "total_unique_users": 2, "active_platforms": 2,
    }


def test_nothing_in_nothing_out(spark):
    empty = make(spark, {}).limit(0)
    assert P.platform_metrics(empty).count() == 0
    assert P.platform_summary(P.platform_metrics(empty)).first()["total_posts"] == 0
    assert P.realtime_stats(empty).first()["posts"] == 0
    assert P.posts_per_minute_summary(P.posts_per_minute(empty)).first()["posts_per_minute"] == 0.0
    assert G.trending_summary(G.trending_topics(G.build_trending(empty))).first()["topics"] == 0


def test_no_known_sentiment(spark):
    assert P.sentiment_distribution(make(spark, {}, {})).count() == 0
    assert P.platform_metrics(make(spark, {})).first()["positive_count"] == 0


def test_percentages_sum_to_hundred(spark, folder):
    shares = P.sentiment_distribution(A.posts(spark, folder)).collect()
    assert abs(sum(r["percentage"] for r in shares) - 100) <= 0.02


def test_platform_counts_sum_to_total(spark, folder):
    posts = A.posts(spark, folder)
    total = P.posts_per_hour(posts).agg(F.sum("post_count")).first()[0]
    assert total == posts.count()


def test_average_counts_only_minutes_with_posts(spark):
    df = make(spark, dict(at=NOON), dict(at=NOON), dict(at=NOON - timedelta(minutes=5)), dict(at=NOON - timedelta(minutes=11)))
    row = P.posts_per_minute_summary(P.posts_per_minute(df)).first()
    assert (row["posts_per_minute"], row["trend"]) == (1.5, [2, 1])


def test_sentiment_series_leaves_absent_values_absent(spark):
    row = P.time_series(make(spark, dict(sentiment="positive")), "sentiment_trend").first()
    assert (row["positive"], row["negative"]) == (1, None)


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        P.time_series(make(spark, {}), "reach")
    with pytest.raises(ValueError):
        P.analytics_report(make(spark, {}), ["reach"])


def test_rollup_rejects_sizes_that_do_not_nest(spark):
    with pytest.raises(ValueError):
        P.rollup_metrics(make(spark, {}), (3600, 5400))


def test_growth_needs_the_hour_before(spark):
    hours = [(0, 2), (1, 6), (3, 9)]
    rows = [dict(at=NOON + timedelta(hours=h), tags=["x"]) for h, n in hours for _ in range(n)]
    grown = G.build_trending(make(spark, *rows), 1).orderBy("time_window").collect()
    assert [None if r["growth_rate"] is None else float(r["growth_rate"]) for r in grown] == [None, 3.0, None]


def test_growth_counts_topics_that_were_cut_the_hour_before(spark):
    rows = [dict(at=NOON, tags=["a"])] * 3 + [dict(at=NOON, tags=["b"])]
    rows += [dict(at=NOON + timedelta(hours=1), tags=["b"])] * 4
    grown = G.build_trending(make(spark, *rows), 1, per_hour=1).orderBy("time_window").collect()
    assert [(r["topic"], r["mentions_before"]) for r in grown] == [("a", None), ("b", 1)]
    assert float(grown[1]["growth_rate"]) == 4.0
    analysis = G.trend_analysis(G.build_trending(make(spark, *rows), 1, per_hour=1)).collect()
    assert [(r["topic"], r["velocity"]) for r in analysis] == [("b", 3.0)]


def test_detect_keeps_groups_of_three(spark):
    rows = [dict(tags=["x"], sentiment="positive")] * 3 + [dict(tags=["y"])] * 2
    found = G.detect_trending(make(spark, *rows)).collect()
    assert [(r["topic"], r["mentions_count"], float(r["sentiment_score"])) for r in found] == [("x", 3, 1.0)]


def test_ties_are_broken_by_name(spark):
    df = make(spark, dict(tags=["b"]), dict(tags=["a"]), dict(tags=["c"]))
    assert [r["hashtag"] for r in P.top_hashtags(df, 2).collect()] == ["a", "b"]


def test_pairs_ignore_repeated_tags(spark):
    pairs = G.tag_pairs(make(spark, dict(tags=["a", "a", "b"]))).collect()
    assert sorted((r["topic"], r["related"], r["together"]) for r in pairs) == [("a", "b", 1), ("b", "a", 1)]


def test_viral_order_across_platforms(spark):
    rows = [dict(platform="reddit", likes=10), dict(platform="reddit", likes=2), dict(platform="twitter", likes=100), dict(platform="twitter", likes=100)]
    best = D.viral_posts(make(spark, *rows), 2).collect()
    assert [(r["post_id"], r["viral_coefficient"]) for r in best] == [("p0", 10 / 6), ("p2", 1.0)]


def test_reach_shares_sum_to_hundred(spark, folder):
    shares = D.influencers(A.posts(spark, folder)).groupBy("platform").agg(F.sum("reach_score").alias("s"))
    assert all(abs(r["s"] - 100) < 2 for r in shares.collect())


def test_deep_page_equals_shallow_page(spark, folder, monkeypatch):
    rows = A.posts(spark, folder).select("post_id", "timestamp")
    order = ["timestamp", "post_id"]
    shallow = R.paginate(rows, order, 77, 40).collect()
    monkeypatch.setattr(R, "DEEP_ROWS", 10)
    assert R.paginate(rows, order, 77, 40).collect() == shallow
    assert len(R.paginate(rows, order, 10**6, 100).collect()) == 0


def test_stored_pages_of_any_depth(spark):
    """Mixed order with NULLs and ties; pages inside a range, over two, the last one, and none."""
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("k"), F.lit(1).alias("_part"))
    folder, order = new_folder(spark, "pages"), [F.desc("k"), F.col("id").desc()]
    R.store_pages(df, order, folder, 90)
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    for page, size in [(1, 20), (5, 20), (7, 50), (50, 20), (34, 30), (51, 20)]:
        found = R.stored_page(spark, folder, order, page, size).orderBy("row_number").collect()
        assert [r["id"] for r in found] == whole[(page - 1) * size : page * size]
        assert [r["row_number"] for r in found] == list(range((page - 1) * size + 1, min(page * size, 1000) + 1))
    plan = R.stored_page(spark, folder, order, 5, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [_range" in plan
    R.store_pages(df.limit(0), order, folder)
    assert R.stored_page(spark, folder, order).count() == 0


def test_stored_ranges_are_bounded(spark, monkeypatch):
    """A long result gets longer ranges, not more of them, and the same pages."""
    monkeypatch.setattr(R, "MAX_RANGES", 4)
    df, folder = spark.range(1000).select("id", (F.col("id") % 5).alias("k")), new_folder(spark, "pages")
    order = [F.desc("k"), F.col("id").desc()]
    R.store_pages(df, order, folder, 10)
    assert spark.read.parquet(f"{folder}/marks").count() <= 4
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    for page in (1, 13, 50, 51):
        found = R.stored_page(spark, folder, order, page, 20).orderBy("row_number").collect()
        assert [r["id"] for r in found] == whole[(page - 1) * 20 : page * 20]


def test_page_size_is_limited(spark):
    with pytest.raises(ValueError):
        R.paginate(make(spark, {}), ["post_id"], 1, 101)


def test_engine_checks_its_arguments(spark):
    engine = Engine(make(spark, {}), G.build_trending(make(spark, {})))
    for call in (
        lambda: engine.trending_topics(limit=51),
        lambda: engine.trending_topics(platform="myspace"),
        lambda: engine.sentiment_overview(hours=200),
        lambda: engine.time_series("reach"),
    ):
        with pytest.raises(ValueError):
            call()
    assert engine.overall_mood().first()["mood"] == "Mixed sentiment"
    assert engine.realtime_stats().first()["posts"] == 1
    assert [r["source"] for r in engine.insights_summary().collect()] == ["active_platforms"]
