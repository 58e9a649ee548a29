"""Connected components of an edge table, by rounds of large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.session import cut_lineage


def _stars(edges: DataFrame) -> DataFrame:
    """Point every node and its larger neighbours to the least of its neighbours (large star)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Point every node's smaller neighbours, and itself, to the least of them. Needs a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .filter("a != b")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) of every node of the edges' first two columns; the component is its least node.

    Nulls and loops are ignored; an empty table gives no rows. A round only moves
    edges, never gathers a node's neighbours, and its result is checkpointed.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b")
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        edges = cut_lineage(_small_stars(_stars(edges)))
        was, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
