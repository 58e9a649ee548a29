"""Rate limits over a request log: limit lookup, window counts, exact admission replay."""

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions.filters import TIME
from pulse.functions.lookups import sized
from pulse.operators.activity import WINDOWS
from pulse.session import cut_lineage

# Workers need not have this package: the function they run is sent whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["client_id", "endpoint"]
MICROS = 1_000_000
DAY = WINDOWS["day"]

# Requests allowed per minute, hour and day.
GENERAL_LIMITS = {
    "anonymous": (20, 100, 1000),
    "authenticated": (60, 1000, 10000),
    "admin": (200, 5000, 50000),
}
# Requests allowed per minute and hour on single endpoints.
ENDPOINT_LIMITS = {
    "/ml/sentiment": {"anonymous": (5, 50), "authenticated": (30, 500), "admin": (100, 2000)},
    "/ml/extract-entities": {"anonymous": (3, 30), "authenticated": (20, 300), "admin": (80, 1500)},
    "/analytics/trending": {"anonymous": (10, 100), "authenticated": (30, 500), "admin": (100, 2000)},
}


def limits_table(spark: SparkSession, general=None, by_endpoint=None) -> DataFrame:
    """Rows (user_type, endpoint or NULL, window_seconds, max_requests)."""
    sizes = tuple(WINDOWS.values())
    general = GENERAL_LIMITS if general is None else general
    by_endpoint = ENDPOINT_LIMITS if by_endpoint is None else by_endpoint
    rows = [(who, None, w, n) for who, ns in general.items() for w, n in zip(sizes, ns)]
    for endpoint, types in by_endpoint.items():
        rows += [(who, endpoint, w, n) for who, ns in types.items() for w, n in zip(sizes, ns)]
    return spark.createDataFrame(
        rows, "user_type string, endpoint string, window_seconds long, max_requests long"
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on `keys` where NULL equals NULL; every row of a log keeps its counts."""
    left, right = left.alias("left"), right.alias("right")
    same = [F.col(f"left.{key}").eqNullSafe(F.col(f"right.{key}")) for key in keys]
    others = [F.col(f"right.{name}") for name in right.columns if name not in keys]
    return left.join(right, same).select("left.*", *others)


def effective_limits(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Add `limit_minute`, `limit_hour`, `limit_day`: the endpoint's own value, else the general one."""

    def wide(rows, keys, prefix):
        return rows.groupBy(*keys).agg(
            *[
                F.max(F.when(F.col("window_seconds") == w, F.col("max_requests"))).alias(prefix + name)
                for name, w in WINDOWS.items()
            ]
        )

    general = wide(limits.filter(F.col("endpoint").isNull()), ["user_type"], "_general_")
    special = wide(limits.filter(F.col("endpoint").isNotNull()), ["user_type", "endpoint"], "_special_")
    # A user type without limits of its own is held to those of anonymous users.
    types = general.select(F.col("user_type").alias("_type"))
    held = log.join(sized(types), F.col("user_type") == F.col("_type"), "left")
    held = held.withColumn("_type", F.coalesce("_type", F.lit("anonymous")))
    joined = held.join(sized(general.withColumnRenamed("user_type", "_type")), "_type", "left").join(
        sized(special.withColumnRenamed("user_type", "_type")), ["_type", "endpoint"], "left"
    )
    found = {
        f"limit_{name}": F.coalesce(f"_special_{name}", f"_general_{name}") for name in WINDOWS
    }
    found["limit_day"] = F.col("_general_day")
    return joined.select(*log.columns, *[c.alias(name) for name, c in found.items()])


def window_counts(log: DataFrame, bin_seconds: int = 60) -> DataFrame:
    """Add `before_minute`, `before_hour`, `before_day`: other requests of the same client and
    endpoint in (t - w, t].

    A frame per row over a client's whole history would put a busy client on
    one task and scan its day again for each request. Instead time is cut into
    bins. Whole bins are counted once and summed per client as a running total
    of entering and leaving counts, which grows with time and not with
    requests. The two cut bins at the ends of (t - w, t] are compared request
    by request inside one (client, endpoint, bin) group: each request is also
    sent, shifted by w, to the bin in which it leaves the window.
    """
    if any(w % bin_seconds for w in WINDOWS.values()):
        raise ValueError("bin_seconds must divide a minute")
    micros = F.unix_micros(F.col(TIME).cast("timestamp"))
    rows = log.withColumn("_us", micros).withColumn(
        "_bin", F.floor(F.col("_us") / F.lit(bin_seconds * MICROS)).cast("long")
    )

    # Whole bins
    bins = rows.groupBy(*KEY, "_bin").agg(F.count("*").alias("n"))
    zero, n, at = F.lit(0).cast("long"), F.col("n"), F.col("_bin")

    def step(position, probe, changes):
        return F.struct(
            position.alias("at"), F.lit(probe).alias("probe"),
            *[changes.get(name, zero).alias(f"whole_{name}") for name in WINDOWS],
        )

    steps = [step(at, True, {}), step(at + 1, False, {name: n for name in WINDOWS})]
    steps += [step(at + w // bin_seconds + 1, False, {name: -n}) for name, w in WINDOWS.items()]
    upto = Window.partitionBy(*KEY).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    whole = (
        bins.select(*KEY, F.inline(F.array(*steps)))
        .withColumns({f"whole_{name}": F.sum(f"whole_{name}").over(upto) for name in WINDOWS})
        .filter("probe")
        .select(*KEY, F.col("at").alias("_bin"), *[f"whole_{name}" for name in WINDOWS])
    )

    # Cut bins
    shifted = rows.withColumn("_shift", F.explode(F.array(*map(F.lit, [0, *WINDOWS.values()]))))
    own = F.col("_shift") == 0
    events = shifted.select(
        *[c if c in KEY else F.when(own, F.col(c)).alias(c) for c in log.columns],
        (F.col("_bin") + (F.col("_shift") / bin_seconds).cast("long")).alias("_bin"),
        (F.col("_us") + F.col("_shift").cast("long") * MICROS).alias("_us"),
        "_shift",
    )
    inside = (
        Window.partitionBy(*KEY, "_bin").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    )
    counted = events.withColumns(
        {
            "_come": F.count_if(own).over(inside),
            **{
                f"_gone_{name}": F.count_if(F.col("_shift") == w).over(inside)
                for name, w in WINDOWS.items()
            },
        }
    ).filter(own)
    before = {
        name: F.col(f"whole_{name}") + F.col("_come") - 1 - F.col(f"_gone_{name}") for name in WINDOWS
    }
    return _join_null_safe(counted, whole, [*KEY, "_bin"]).select(
        *log.columns, *[c.alias(f"before_{name}") for name, c in before.items()]
    )


def limit_pressure(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Window counts of every request with the first window whose limit they reach, if any."""
    counted = window_counts(effective_limits(log, limits))
    reached = [
        F.when(F.col(f"before_{name}") >= F.col(f"limit_{name}"), name) for name in WINDOWS
    ]
    left = F.greatest(F.col("limit_minute") - F.col("before_minute") - 1, F.lit(0))
    return counted.withColumn("reached", F.coalesce(*reached)).withColumn("remaining", left)


_REPLAY_IN = [*KEY, "segment", "id", TIME, "_us", "before_minute", "at_risk", *[f"limit_{n}" for n in WINDOWS]]
_REPLAY_OUT = "allowed boolean, denied_window string, remaining long, reset_us long"


def _replay_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Admission of requests that arrive sorted by segment and time.

    State is the recorded times of the current segment per window. Each list
    is as long as its limit at most, however many requests the segment has.
    """
    names, spans = list(WINDOWS), [w * MICROS for w in WINDOWS.values()]
    current, kept, seen_risk = None, None, False
    for pdf in batches:
        segment = list(zip(pdf["client_id"], pdf["endpoint"], pdf["segment"]))
        us, risk, before = (pdf[c].tolist() for c in ("_us", "at_risk", "before_minute"))
        limit = [pdf[f"limit_{name}"].tolist() for name in names]
        size = len(pdf)
        allowed = np.zeros(size, dtype=bool)
        denied = np.full(size, None, dtype=object)
        remaining = np.zeros(size, dtype=np.int64)
        reset = np.zeros(size, dtype=np.int64)
        i = 0
        while i < size:
            if segment[i] != current:
                current, kept, seen_risk = segment[i], [deque() for _ in names], False
            t = us[i]
            seen_risk = seen_risk or risk[i]
            stop = None
            for w, times in enumerate(kept):
                while times and times[0] <= t - spans[w]:
                    times.popleft()
                if len(times) >= limit[w][i]:
                    stop = w
                    break
                if not times or times[-1] != t:
                    times.append(t)
            if stop is None:
                allowed[i] = True
                used = len(kept[0]) if seen_risk else before[i] + 1
                full = used >= limit[0][i]
                remaining[i] = 0 if full else limit[0][i] - used
                reset[i] = (kept[0][0] if full else t) + spans[0]
                i += 1
                continue
            free = (kept[stop][0] if kept[stop] else t) + spans[stop]
            end = i + 1
            if stop == 0 and kept[0]:
                # A full minute records nothing, so all requests until it frees meet the same state.
                while end < size and us[end] < free and segment[end] == current and limit[0][end] == limit[0][i]:
                    end += 1
            denied[i:end] = names[stop]
            reset[i:end] = free
            i = end
        out = pdf[[*KEY, "id", TIME]].copy()
        out["allowed"], out["denied_window"] = allowed, denied
        out["remaining"], out["reset_us"] = remaining, reset
        yield out


def replay_limits(log: DataFrame, limits: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """Sequential admission: a denied request does not count, except in the windows checked before
    the one that denied it. Requests of one client and endpoint at the same microsecond count once.

    All requests together bound what can be recorded, so where even they stay
    under every limit a request is surely allowed and Spark decides it alone.
    Only segments around times at risk, each with the full day before it, are
    replayed in order. A segment streams through its task in sorted batches.
    """
    base = effective_limits(log, limits).select(
        *KEY, "id", TIME, *[f"limit_{name}" for name in WINDOWS]
    )
    ticks = window_counts(base.select(*KEY, TIME).distinct())
    rows = _join_null_safe(base, ticks, [*KEY, TIME])
    rows = rows.withColumns(
        {
            "_us": F.unix_micros(F.col(TIME).cast("timestamp")),
            "at_risk": F.greatest(
                *[F.col(f"before_{name}") + 1 >= F.col(f"limit_{name}") for name in WINDOWS]
            ),
        }
    ).withColumn("_bin", F.floor(F.col("_us") / F.lit(bin_seconds * MICROS)).cast("long"))
    rows = cut_lineage(rows)  # read three times below

    placed = _join_null_safe(rows, _segments(rows, -(-DAY // bin_seconds) + 1), [*KEY, "_bin"])

    used = F.col("before_minute") + 1
    calm = placed.filter(F.col("segment").isNull()).select(
        *KEY, "id", TIME,
        F.lit(True).alias("allowed"),
        F.lit(None).cast("string").alias("denied_window"),
        (F.col("limit_minute") - used).alias("remaining"),
        (F.col("_us") + WINDOWS["minute"] * MICROS).alias("reset_us"),
    )
    replayed = (
        placed.filter(F.col("segment").isNotNull())
        .select(*_REPLAY_IN)
        .repartition(*KEY, "segment")
        .sortWithinPartitions(*KEY, "segment", "_us", "id")
        .mapInPandas(_replay_sorted, _out_layout(log))
    )
    return calm.unionByName(replayed).withColumn(
        "reset_time", F.timestamp_micros("reset_us").cast(log.schema[TIME].dataType)
    ).drop("reset_us")


def _segments(rows: DataFrame, reach: int) -> DataFrame:
    """(client, endpoint, bin, segment): bins at risk and the `reach` bins before each share a segment
    as long as no longer gap parts them; `segment` is NULL for all other bins.

    Works on one row per bin, so it grows with time and not with requests.
    """
    bins = rows.groupBy(*KEY, "_bin").agg(F.max("at_risk").alias("risky"))
    risky_bin = F.when(F.col("risky"), F.col("_bin"))
    forward = Window.partitionBy(*KEY).orderBy("_bin")
    backward = Window.partitionBy(*KEY).orderBy(F.desc("_bin"))
    before = F.last(risky_bin, ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(risky_bin, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0))
    parted = F.col("before").isNull() | (F.col("after") - F.col("before") > reach)
    started = F.count_if(F.col("risky") & parted).over(forward)
    segment = started + F.when(~F.col("risky") & parted, 1).otherwise(0)
    return (
        bins.withColumns({"before": before, "after": after})
        .withColumn("segment", F.when(F.col("after") - F.col("_bin") <= reach, segment))
        .select(*KEY, "_bin", "segment")
    )


def _out_layout(log: DataFrame) -> str:
    kept = ", ".join(f"`{c}` {log.schema[c].dataType.simpleString()}" for c in [*KEY, "id", TIME])
    return f"{kept}, {_REPLAY_OUT}"
