from collections import defaultdict
from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from pulse.functions import lexicons as LX
from pulse.operators import posts as P
from pulse.operators import tables as T
from pulse.session import kept_partitions, new_folder
from pulse.sources import adapters as A
from pulse.sources.tables import read_table
from pulse.streaming import ingest as S
from pulse.streaming import windows as W

T0 = datetime(2024, 1, 1)
LAYOUT = "post_id string, platform string, author string, content string, timestamp timestamp, likes_count int, shares_count int, comments_count int, sentiment string, processing_time_ms int"


def row(i, minutes, content="great #ai"):
    return (f"p{i}", "twitter", f"u{i % 3}", content, T0 + timedelta(minutes=minutes), 1, 1, 1, "positive", 5)


def write(spark, folder, rows):
    spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def scorers(spark):
    return S.Scorers(LX.sentiment_lexicon(spark), LX.emotion_lexicon(spark), LX.entity_dictionary(spark))


def test_closed_hours_equal_the_batch(spark, folder):
    """The events arrive in time order, a week at a time; the stream stops and resumes in between."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    parts, out, offsets = (new_folder(spark, n) for n in ("events", "hours", "offsets"))
    for week in range(5):
        inside = F.floor(F.dayofmonth("ts") / 7) == week
        events.filter(inside).coalesce(1).write.mode("append").parquet(parts)
        stream = spark.readStream.schema(events.schema).parquet(parts)
        posts = A.posts_of_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))
        W.append_to(W.stream_posts_per_hour(posts), out, offsets).awaitTermination()
    closed = spark.read.parquet(out).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    exact = P.posts_per_hour(A.posts(spark, folder))
    last = closed.agg(F.max("bucket")).first()[0]
    assert closed.count() > 2000
    assert sorted(closed.collect()) == sorted(exact.filter(F.col("bucket") <= last).select(*closed.columns).collect())


def test_late_posts_are_dropped(spark):
    folder, out = new_folder(spark, "late"), new_folder(spark, "hours")
    offsets = new_folder(spark, "offsets")

    def step(rows):
        write(spark, folder, rows)
        W.append_to(W.stream_posts_per_hour(source(spark, folder)), out, offsets).awaitTermination()

    step([row(0, 10)])
    step([row(1, 60 * 5)])
    step([row(2, 20), row(3, 60 * 9)])
    counted = {r["bucket"].hour: r["post_count"] for r in spark.read.parquet(out).collect()}
    assert counted == {0: 1, 5: 1}


def test_update_streams_count_everything(spark):
    folder = new_folder(spark, "minutes")
    write(spark, folder, [row(i, i % 2) for i in range(4)])
    write(spark, folder, [row(9, 1)])
    out = new_folder(spark, "ppm")
    W.update_to(W.stream_ppm(source(spark, folder)), out, new_folder(spark, "offsets")).awaitTermination()
    assert sorted(r["posts"] for r in W.current_rows(spark, out, ["minute"]).collect()) == [2, 3]
    out = new_folder(spark, "last")
    W.update_to(W.stream_last_hour(source(spark, folder)), out, new_folder(spark, "offsets")).awaitTermination()
    rows = W.last_hour_stats(W.current_rows(spark, out, ["minute"]))
    best = rows.orderBy(F.desc("posts"), "window_end").first()
    assert (best["posts"], best["active_users"], best["positive_count"]) == (5, 3, 5)


def test_sliding_authors_equal_brute_force(spark):
    """Gaps around the span, minutes over several days, repeated rows, no author, no time."""
    random = Random(3)
    seen = [(f"u{random.randrange(6)}", random.choice([0, 1, 59, 60, 61, 62, 1435, 1440, 1499, 4000]) + random.randrange(4)) for _ in range(150)]
    seen += [("u0", 0), ("u0", 60), ("u0", 121), (None, 9000)]
    rows = [(author, T0 + timedelta(minutes=m)) for author, m in seen] + [("u1", None)]
    df = spark.createDataFrame(rows, "author string, minute timestamp")
    for span in (1, 5, 60):
        expected = defaultdict(set)
        for author, m in seen:
            for end in range(m + 1, m + span + 1):
                expected[T0 + timedelta(minutes=end)] |= {author} - {None}
        found = {r["window_end"]: r["active_users"] for r in W.sliding_active_users(df, span).collect()}
        assert found == {end: len(authors) for end, authors in expected.items()}
    assert W.sliding_active_users(df.limit(0)).count() == 0


def test_sketch_of_authors_is_near_the_exact_count(spark, folder):
    posts = A.posts(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sketch = W.last_hour_stats(W.stream_last_hour(posts)).select("window_end", F.col("active_users").alias("near"))
    exact = W.sliding_active_users(W.stream_author_minutes(posts))
    worst = exact.join(sketch, "window_end").agg(F.max(F.abs(F.col("near") - F.col("active_users")) / F.col("active_users")), F.count("*")).first()
    assert worst[0] <= 0.05 and worst[1] == exact.count() > 0


def test_update_streams_count_late_posts(spark):
    """The second batch is ten hours behind the first."""
    folder, minutes, parts, *offsets = (new_folder(spark, n) for n in ("late", "ppm", "last", "offsets", "offsets"))
    for rows in ([row(0, 600), row(1, 601)], [row(2, 0), row(3, 0), row(4, 1), row(5, 600)]):
        write(spark, folder, rows)
        W.update_to(W.stream_ppm(source(spark, folder)), minutes, offsets[0]).awaitTermination()
        W.update_to(W.stream_last_hour(source(spark, folder)), parts, offsets[1]).awaitTermination()
    expected = {0: 2, 1: 1, 600: 2, 601: 1}
    for out in (minutes, parts):
        found = W.current_rows(spark, out, ["minute"]).collect()
        assert {int((r["minute"] - T0).total_seconds() // 60): r["posts"] for r in found} == expected


def test_ingest_in_batches(spark, scorers):
    folder, out, offsets = (new_folder(spark, n) for n in ("in", "out", "offsets"))

    def step(rows):
        write(spark, folder, rows)
        S.ingest_stream(
            source(spark, folder).drop("sentiment"), out, offsets, scorers, trending={"min_mentions": 2}
        ).awaitTermination()
        return S.stored_posts(spark, out)

    assert step([row(0, 0), row(1, 1), row(1, 1)]).count() == 2
    # an old copy, long past the watermark, and two posts of the next day
    stored = step([row(0, 0), row(2, 60 * 30, "broken #ai with Jane Doe"), row(3, 60 * 30 + 1, "")])
    assert sorted(r["post_id"] for r in stored.collect()) == ["p0", "p1", "p2", "p3"]
    last = step([row(2, 60 * 30, "changed"), row(4, 60 * 30 + 2)]).orderBy("post_id").collect()
    assert [r["sentiment"] for r in last] == ["positive", "positive", "negative", "neutral", "positive"]
    assert [r["hashtags"] for r in last] == [["ai"], ["ai"], ["ai"], [], ["ai"]]
    assert last[2]["topics"] == ["jane doe"] and last[3]["emotions"] == {}
    assert sum(last[0]["sentiment_scores"].values()) == pytest.approx(1)

    topics = read_table(spark, "trending_topics", out).orderBy("time_window").collect()
    assert [(r["topic"], r["time_window"].hour, r["mentions_count"]) for r in topics] == [("ai", 0, 2), ("ai", 6, 2)]
    stats = spark.read.parquet(f"{out}/realtime_stats").first()["record"]
    assert '"posts_today":3' in stats


def test_ingest_stores_late_and_future_posts(spark):
    folder, out, offsets = (new_folder(spark, n) for n in ("in", "out", "offsets"))
    ahead = 60 * 24 * 365 * 100  # minutes: a clock a century ahead
    for rows in ([row(0, ahead)], [row(1, 60 * 48)], [row(2, 0), row(3, 1), row(1, 60 * 48)]):
        write(spark, folder, rows)
        S.ingest_stream(source(spark, folder), out, offsets).awaitTermination()
    found = S.stored_posts(spark, out).select("post_id").collect()
    assert sorted(r["post_id"] for r in found) == ["p0", "p1", "p2", "p3"]
    assert '"posts_today":1' in spark.read.parquet(f"{out}/realtime_stats").first()["record"]


def test_a_repeated_batch_replaces_itself(spark):
    out = new_folder(spark, "out")
    batch = spark.createDataFrame([row(0, 0), row(1, 1)], LAYOUT)
    for _ in range(2):
        S.store(S.unseen(batch, "s_0", out), "s_0", out)
    assert S.stored_posts(spark, out).count() == 2
    S.store(S.unseen(batch, "s_1", out), "s_1", out)
    assert S.stored_posts(spark, out).count() == 2
    assert S.id_index(spark, out).count() == 2


def test_a_second_stream_keeps_what_the_first_one_stored(spark):
    """Batch numbers begin anew with a new checkpoint: no post is lost, replaced or stored twice."""
    out, minutes = new_folder(spark, "out"), new_folder(spark, "minutes")
    for rows in ([row(0, 0), row(1, 1), row(2, 2)], [row(3, 0), row(1, 1), row(4, 60 * 30)]):
        folder, offsets, others = (new_folder(spark, n) for n in ("in", "offsets", "others"))
        write(spark, folder, rows)
        S.ingest_stream(source(spark, folder), out, offsets).awaitTermination()
        W.update_to(W.stream_ppm(source(spark, folder)), minutes, others).awaitTermination()
    assert sorted(r["post_id"] for r in S.stored_posts(spark, out).collect()) == ["p0", "p1", "p2", "p3", "p4"]
    found = {(r["minute"] - T0).total_seconds() // 60: r["posts"] for r in W.current_rows(spark, minutes, ["minute"]).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 1800: 1}


def test_only_hit_buckets_of_the_index_are_read(spark):
    out = new_folder(spark, "out")
    first = spark.createDataFrame([row(i, i) for i in range(200)], LAYOUT)
    S.store(S.unseen(first, "s_0", out), "s_0", out)
    batch = spark.createDataFrame([row(7, 7), row(900, 1)], LAYOUT)
    seen = S.seen_ids(batch, "t_0", out)
    assert [r["post_id"] for r in seen.collect()] == ["p7"]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert S.stored_posts(spark, out).count() == 200
    # A store from before it had an index gets one.
    old = new_folder(spark, "old")
    spark.read.parquet(f"{out}/{S.POSTS}").write.partitionBy("ts_date", "batch").parquet(f"{old}/{S.POSTS}")
    assert [r["post_id"] for r in S.unseen(batch, "t_0", old).collect()] == ["p900"]
    assert S.id_index(spark, old).count() == 200


def test_day_state_equals_the_days_posts(spark):
    """Batches that share authors, tags and minutes, one of them repeated; a post of the future does not count."""
    out = new_folder(spark, "out")
    layout = "post_id string, author string, sentiment string, hashtags array<string>, timestamp timestamp"
    rows = [
        (f"p{i}", f"u{i % 5}" if i % 7 else None, [None, "positive", "negative", "neutral", "odd"][i % 5], [f"t{i % 3}", f"t{i % 4}"] if i % 6 else None, T0 + timedelta(minutes=37 * i))
        for i in range(90)
    ]
    for name, part in (("a_0", rows[:40]), ("a_1", rows[40:]), ("a_1", rows[40:])):
        batch = spark.createDataFrame(part, layout)
        S.store(S.unseen(batch, name, out), name, out)
    for minutes in (37 * 89, 37 * 60, 37 * 39, 0, 60 * 24 * 5):
        as_of = str(T0 + timedelta(minutes=minutes))
        posts = spark.createDataFrame(rows, layout).filter(F.col("timestamp") <= as_of)
        stats = S.day_stats(spark, out, as_of)
        assert [r.asDict() for r in stats.collect()] == [r.asDict() for r in P.today_stats(posts, as_of).collect()]
    assert S.POSTS not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"/{S.DAYS}/" in f for f in stats.inputFiles())


def test_trending_refresh_knows_growth_and_keywords(spark):
    out = new_folder(spark, "out")
    posts = lambda n, minutes: [
        (f"p{minutes}-{i}", "twitter", T0 + timedelta(minutes=minutes), "positive", ["ai", "ml"]) for i in range(n)
    ]
    layout = "post_id string, platform string, timestamp timestamp, sentiment string, hashtags array<string>"
    for rows in (posts(3, 1410), posts(3, 1410) + posts(6, 1470), posts(3, 1410) + posts(6, 1470) + posts(3, 1480)):
        df = spark.createDataFrame(rows, layout)
        S.refresh_trending(df, out, str(df.agg(F.max("timestamp")).first()[0]))
    found = read_table(spark, "trending_topics", out).orderBy("time_window", "topic").collect()
    assert [(r["topic"], r["mentions_count"], r["growth_rate"], r["related_keywords"]) for r in found] == [
        ("ai", 3, None, ["ml"]), ("ml", 3, None, ["ai"]), ("ai", 9, 3, ["ml"]), ("ml", 9, 3, ["ai"]),
    ]


def test_trending_refresh_counts_the_hour_before_from_posts(spark):
    out = new_folder(spark, "out")
    rows = [("a", "twitter", T0, "positive", ["new"])] * 2  # too few to be stored
    rows += [("b", "twitter", T0 + timedelta(minutes=70), "positive", ["new"])] * 5
    layout = "post_id string, platform string, timestamp timestamp, sentiment string, hashtags array<string>"
    S.refresh_trending(spark.createDataFrame(rows, layout), out, str(T0 + timedelta(minutes=75)))
    assert [(r["topic"], float(r["growth_rate"])) for r in read_table(spark, "trending_topics", out).collect()] == [("new", 2.5)]


def test_writing_the_index_leaves_the_cached_batch(spark):
    """Posts that are cached over a look-up of stored ids are worked out once, though a batch writes that index."""
    out = new_folder(spark, "posts")
    days = "timestamp'2024-03-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) AS timestamp"
    posts = spark.range(60).selectExpr("concat('p', id) AS post_id", days, "'twitter' AS platform", "'a' AS author")
    S.store(posts.limit(20), "s_0", out)
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(author):
        worked.add(1)
        return author

    batch = posts.withColumn("author", counted("author"))
    fresh = S.unseen(T.first_per_key(batch, ["post_id"], ["timestamp"]), "s_1", out, ids=posts).persist()
    S.store(fresh, "s_1", out)
    fresh.unpersist()
    assert worked.value == 60
    assert S.stored_posts(spark, out).groupBy("batch").count().orderBy("batch").collect() == [("s_0", 20), ("s_1", 40)]


def test_enrichment_shuffles_no_text_of_a_batch_by_id(spark, scorers):
    posts = spark.range(50).selectExpr("concat('p', id) AS post_id", "current_timestamp() AS timestamp", "'good day' AS content")
    with kept_partitions(spark):
        fresh = T.first_per_key(posts, ["post_id"], ["timestamp"]).persist()
    fresh.count()
    plan = S.enrich(fresh, scorers)._jdf.queryExecution().executedPlan().toString()
    fresh.unpersist()
    own = plan.replace("InMemoryRelation", "\0").split("\0")  # what made the cached table is not of interest
    assert "Exchange hashpartitioning(post_id" not in own[0]


def test_only_the_rows_that_are_written_are_held(spark, scorers, monkeypatch):
    """The rows of earlier steps are let go before a batch is written; its texts were held three times."""
    held, stored = [], S.store

    def store(found, *args):
        stored(found, *args)
        held.append(spark.sparkContext._jsc.sc().getPersistentRDDs().size() - before)

    monkeypatch.setattr(S, "store", store)
    feed, target = new_folder(spark, "feed"), new_folder(spark, "ingest")
    write(spark, feed, [row(i, i) for i in range(20)])
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    S.ingest_stream(source(spark, feed), target, new_folder(spark, "offsets"), scorers).awaitTermination()
    assert held == [1]
    assert S.stored_posts(spark, target).count() == 20
