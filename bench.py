"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every result
is computed in full and written to the no-op sink.
"""

import json
import os
import time

from pulse.plans import QUERIES
from pulse.session import build_session

HEADLINE = [
    "F01_hourly_sentiment", "F02_posts_per_hour", "F03_sentiment_distribution", "F05_platform_metrics",
    "F07_top_hashtags", "F09_series_sentiment", "F15_today_stats", "F16_user_engagement", "F17_rollup_metrics",
    "F19_analytics_report", "G01_detect_trending", "G02_trending_topics", "G03_daily_trending",
    "G06_build_trending", "H04_paginate", "I01_user_stats", "I03_global_stats", "I04_limit_pressure",
    "I06_replay_limits", "I07_fixed_window_counts", "J01_influencers", "J02_related_tags", "J03_viral_posts",
    "J07_mention_degrees", "J08_insights", "A02_insert_new", "A03_upsert", "D03_validate_posts",
    "E01_clean_text", "E02_extract_tags", "E07_score_sentiment", "E09_extract_entities",
    "E10_tfidf_vocabulary", "E10_tfidf_features", "E11_extract_topics", "E13_score_distinct",
    "K03_stream_posts_per_hour", "K01_ingest_stream",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "pulse-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("F05_platform_metrics")  # starts the JVM and loads classes
    seconds = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
