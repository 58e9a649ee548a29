"""Window counts and admission against a direct simulation on small logs."""

import random
from datetime import datetime, timedelta

import pytest

from pulse.operators import limits as L

EPOCH = datetime(1970, 1, 1)
START = datetime(2024, 1, 1)
SPANS = [("minute", 60), ("hour", 3600), ("day", 86400)]
LAYOUT = "id long, client_id string, endpoint string, user_type string, timestamp timestamp_ntz"


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def random_log(seed, n, seconds, clients=2):
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.uniform(0, seconds), rng.randrange(0, seconds, 30)]) for _ in range(n))
    rows, hot = [], "hot"
    for i, t in enumerate(times):
        client = hot if rng.random() < 0.4 else f"c{rng.randrange(clients)}"
        user = "admin" if client == hot else "anonymous"
        rows.append((i, client, rng.choice(["/a", "/b"]), user, START + timedelta(seconds=t)))
    return rows


def replay(rows, general, special):
    recorded, out = {}, {}
    for id_, client, endpoint, user, time in sorted(rows, key=lambda r: (r[4], r[0])):
        limits = list(general[user])
        limits[:2] = special.get(endpoint, {}).get(user, limits[:2])
        sets = recorded.setdefault((client, endpoint), [set(), set(), set()])
        t, denied = micros(time), None
        for w, (name, span) in enumerate(SPANS):
            sets[w] = {s for s in sets[w] if s > t - span * 10**6}
            if len(sets[w]) >= limits[w]:
                denied, left, free = name, 0, min(sets[w], default=t) + span * 10**6
                break
            sets[w].add(t)
        if denied is None:
            full = len(sets[0]) >= limits[0]
            left = 0 if full else limits[0] - len(sets[0])
            free = (min(sets[0]) if full else t) + 60 * 10**6
        out[id_] = (denied is None, denied, left, free)
    return out


CASES = [
    (1, 400, 600, {"anonymous": (3, 20, 40), "admin": (5, 30, 60)}, {}),
    (2, 500, 4 * 3600, {"anonymous": (2, 9, 30), "admin": (3, 25, 50)}, {"/a": {"anonymous": (1, 4), "admin": (2, 7)}}),
    (3, 500, 6 * 86400, {"anonymous": (2, 3, 12), "admin": (2, 5, 20)}, {}),
    (4, 60, 20 * 86400, {"anonymous": (1, 1, 2), "admin": (1, 2, 3)}, {}),
    (5, 200, 3600, {"anonymous": (0, 5, 5), "admin": (2, 5, 5)}, {}),
]


@pytest.mark.parametrize("seed, n, seconds, general, special", CASES)
def test_replay_equals_simulation(spark, seed, n, seconds, general, special):
    rows = random_log(seed, n, seconds)
    log = spark.createDataFrame(rows, LAYOUT)
    found = L.replay_limits(log, L.limits_table(spark, general, special)).collect()
    mine = {r["id"]: (r["allowed"], r["denied_window"], r["remaining"], micros(r["reset_time"])) for r in found}
    assert len(found) == n and mine == replay(rows, general, special)


@pytest.mark.parametrize("bin_seconds", [60, 20])
def test_window_counts_equal_brute_force(spark, bin_seconds):
    rows = random_log(7, 500, 3 * 86400)
    found = L.window_counts(spark.createDataFrame(rows, LAYOUT), bin_seconds).collect()
    assert len(found) == len(rows)
    for r in found:
        for name, span in SPANS:
            low = r["timestamp"] - timedelta(seconds=span)
            same = [x for x in rows if x[1] == r["client_id"] and x[2] == r["endpoint"]]
            assert r[f"before_{name}"] == sum(low < x[4] <= r["timestamp"] for x in same) - 1


def test_a_request_exactly_one_window_back_is_out(spark):
    rows = [(i, "c", "/a", "admin", START + timedelta(seconds=s)) for i, s in enumerate((0, 60, 119))]
    counts = L.window_counts(spark.createDataFrame(rows, LAYOUT)).orderBy("id").collect()
    assert [r["before_minute"] for r in counts] == [0, 0, 1]


def test_two_requests_at_one_microsecond(spark):
    rows = [(i, "c", "/a", "admin", START) for i in range(2)]
    general = {"admin": (1, 10, 10)}
    found = L.replay_limits(spark.createDataFrame(rows, LAYOUT), L.limits_table(spark, general, {})).orderBy("id")
    assert [r["allowed"] for r in found.collect()] == [True, False]


def test_huge_limits_deny_nothing(spark):
    log = spark.createDataFrame(random_log(8, 300, 3600), LAYOUT)
    limits = L.limits_table(spark, {"anonymous": (10**6,) * 3, "admin": (10**6,) * 3}, {})
    assert L.replay_limits(log, limits).filter("NOT allowed").count() == 0


def test_allowed_never_exceeds_a_limit(spark):
    general = {"anonymous": (3, 10, 20), "admin": (4, 12, 25)}
    log = spark.createDataFrame(random_log(9, 600, 5 * 3600), LAYOUT)
    allowed = L.replay_limits(log, L.limits_table(spark, general, {})).filter("allowed")
    counts = L.window_counts(allowed.select("id", "client_id", "endpoint", "timestamp").dropDuplicates(["client_id", "endpoint", "timestamp"]))
    for r in counts.collect():
        limit = general["admin" if r["client_id"] == "hot" else "anonymous"]
        assert all(r[f"before_{name}"] + 1 <= limit[w] for w, (name, _) in enumerate(SPANS))


def test_state_survives_batch_borders(spark):
    """One hot client in Arrow batches of 7 rows."""
    rows = [r for r in random_log(10, 400, 1200) if r[1] == "hot"]
    general = {"admin": (4, 30, 100)}
    log = spark.createDataFrame(rows, LAYOUT)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        found = L.replay_limits(log, L.limits_table(spark, general, {})).collect()
    finally:
        spark.conf.set(key, old)
    assert {r["id"]: r["allowed"] for r in found} == {k: v[0] for k, v in replay(rows, general, {}).items()}
