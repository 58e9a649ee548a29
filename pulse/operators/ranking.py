"""Top rows and pages of a result."""

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions import params
from pulse.session import cut_lineage


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def arg_top(df: DataFrame, order: list) -> DataFrame:
    """The first row in `order`."""
    return top_k(df, order, 1)


# Pages that start beyond this row are cut from a range-partitioned copy of the result.
DEEP_ROWS = 100_000


def paginate(df: DataFrame, order: list[str | Column], page: int = 1, size: int = 20) -> DataFrame:
    """Rows of one page in `order`, with `row_number` in the whole result.

    Early pages are a distributed top-k. For a deep page the result is range
    partitioned by `order`; row counts per partition then name the few
    partitions that hold the page, and only those are sorted.
    """
    params.between(size, 1, params.MAX_PAGE_SIZE, "page_size")
    params.between(page, 1, 2**31, "page")
    first, last = (page - 1) * size + 1, page * size
    if last <= DEEP_ROWS:
        rows = df.orderBy(*order).offset(first - 1).limit(size)
        return _number(rows, order, first - 1)
    return _deep_page(df, order, first, last)


def _number(rows: DataFrame, order, before: int) -> DataFrame:
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.withColumn("row_number", position + F.lit(before).cast("long"))


def _deep_page(df: DataFrame, order: list[str | Column], first: int, last: int) -> DataFrame:
    parted = cut_lineage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    before, wanted, start = 0, [], 0
    for part, n in sorted(parted.groupBy("_part").count().collect()):
        if before < last and before + n >= first:
            start = start if wanted else before
            wanted.append(part)
        before += n
    rows = parted.filter(F.col("_part").isin(wanted)).drop("_part")
    page = rows.orderBy(*order).offset(max(first - 1 - start, 0)).limit(last - first + 1)
    return _number(page, order, first - 1)


#: Most ranges of a stored result. Spark holds each range's bounds and its task in the driver.
MAX_RANGES = 1_000


def store_pages(df: DataFrame, order: list[str | Column], folder: str, rows_per_range: int = 100_000) -> None:
    """Store a result that is paged often: its rows in ranges of `order`, and a table of marks, the rows of
    each range and before it.

    A result of more than `MAX_RANGES` times `rows_per_range` rows has longer ranges. Spark samples their
    bounds. `order` should end with a key that is unique: rows equal in all of
    it are in no fixed order and share a range. A result without rows has no marks.
    """
    df.limit(0).write.mode("overwrite").parquet(f"{folder}/layout")
    ranges = min(max(1, ceil(df.count() / rows_per_range)), MAX_RANGES)
    parted = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    rows = parted.sortWithinPartitions("_range", *order)
    rows.write.mode("overwrite").partitionBy("_range").parquet(f"{folder}/rows")
    # one row per range
    sizes = df.sparkSession.read.schema(parted.schema).parquet(f"{folder}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    marks = sizes.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    marks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks")


def stored_page(spark: SparkSession, folder: str, order: list[str | Column], page: int = 1, size: int = 20) -> DataFrame:
    """`paginate` of a stored result: whatever the depth, only the ranges that the marks name are read and sorted."""
    params.between(size, 1, params.MAX_PAGE_SIZE, "page_size")
    params.between(page, 1, 2**31, "page")
    first, last = (page - 1) * size, page * size
    marks = spark.read.schema("_range int, n long, before long").parquet(f"{folder}/marks")
    held = marks.filter((F.col("before") < last) & (F.col("before") + F.col("n") > first))
    wanted = sorted(held.select("before", "_range").collect())  # at most one range per row of the page
    start = wanted[0][0] if wanted else first
    layout = spark.read.parquet(f"{folder}/layout").schema.add("_range", "integer")
    rows = spark.read.schema(layout).parquet(f"{folder}/rows").filter(F.col("_range").isin([part for _, part in wanted])).drop("_range")
    return _number(rows.orderBy(*order).offset(first - start).limit(size), order, first)


def page_info(df: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    pages = F.ceil(F.col("total") / size)
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).cast("long").alias("page"),
        F.lit(size).cast("long").alias("page_size"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_previous"),
    )
