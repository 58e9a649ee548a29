"""K-means of several starts against pyspark.ml's own, one fit for each start."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import LongType, StructField, StructType

from pulse.operators.clusters import assigned, best_clustering
from pulse.operators.topics import extract_topics

LAYOUT = StructType([StructField("id", LongType()), StructField("features", VectorUDT())])
WORDS = "red green blue sun moon star cat dog bird tea milk water road house tree".split()


def _vectors(spark, n, width, parts=3):
    """Unit vectors in four loose groups, a zero vector and copies among them."""
    rng, rows = np.random.default_rng(n), []
    for i in range(n):
        places = np.unique(np.append(rng.integers(0, width // 4, 3) + i % 4 * (width // 4), rng.integers(0, width)))
        values = rng.random(len(places)) + 0.1
        vector = Vectors.sparse(width, places.tolist(), (values / np.linalg.norm(values)).tolist())
        rows.append((i, Vectors.sparse(width, [], []) if i == 1 else rows[-1][1] if i % 7 == 6 else vector))
    df = spark.createDataFrame(rows, LAYOUT).repartitionByRange(parts, "id").persist()
    df.count()
    return df


@pytest.mark.parametrize("n, width, k", [(300, 200, 4), (40, 12, 3)])
def test_starts_are_those_of_spark(spark, n, width, k):
    df = _vectors(spark, n, width)
    costs = []
    for seed in (42, 7):
        model, own = KMeans(k=k, seed=seed).fit(df), best_clustering(df, k, [seed])
        assert np.allclose(np.array(model.clusterCenters()), own.centres, atol=1e-9)
        assert own.cost == pytest.approx(model.summary.trainingCost, abs=1e-9)
        expected = {row["id"]: row["prediction"] for row in model.transform(df).collect()}
        assert dict(assigned(df, own, "id", "cluster").collect()) == expected
        costs.append(own.cost)
    several = best_clustering(df, k, [42, 7])
    assert several.cost == pytest.approx(min(costs))
    df.unpersist()


def test_starts_share_their_scans(spark):
    """With ten fits one by one this took 189 jobs."""
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(WORDS[i % 3 * 5 :][:8], 6))) for i in range(200)]
    df = spark.createDataFrame(texts, "post_id long, content string")
    spark.sparkContext.setJobGroup("topics", "topics")
    try:
        found = extract_topics(df)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert found.assignments.count() == 200
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("topics"))
    assert jobs < 100
