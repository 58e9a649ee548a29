"""Joins to lookup tables that are usually small but need not be."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def sized(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark `table` for broadcast if a count shows it is small.

    A larger table is joined by shuffle; adaptive execution then splits the
    tasks of hot keys.
    """
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def join_hot(
    rows: DataFrame, table: DataFrame, key: str, spread_by: str, share: float = 0.001, rows_per_task: int = 1_000_000
) -> DataFrame:
    """Left join of `rows` to a table with one row per `key`, where few keys may own most rows.

    A key is hot if it has more than `share` of all rows and more than one
    task should take. There are fewer than 1/share of them, so their list is
    safe to broadcast. Rows of a hot key are dealt by `spread_by` over as many
    tasks as they need, and its table row is copied to each.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.filter((F.col("_n") > total * share) & (F.col("_n") > rows_per_task)).select(
        key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")
    )
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")
    )
    copied = table.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return dealt.drop("_salts").join(copied.drop("_salts"), [key, "_salt"], "left").drop("_salt")
