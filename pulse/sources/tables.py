"""Typed scans and partitioned writes of the stored tables."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse import schemas

#: Folder of the notes on changed days, a row for each write and day.
NOTES = "changed_days"


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Scan one stored table; a filter on its `ts_date` column prunes folders."""
    if name not in schemas.TABLES:
        raise ValueError(f"unknown table: {name}")
    layout = T.StructType([*schemas.TABLES[name].fields, T.StructField("ts_date", T.DateType())])
    return spark.read.schema(layout).parquet(f"{folder}/{name}")


def shape(df: DataFrame, name: str) -> DataFrame:
    """The table's own columns in order and type; columns `df` lacks are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.TABLES[name].fields
        ]
    )


def write_table(df: DataFrame, name: str, folder: str, mode: str = "append") -> None:
    """Write rows under one folder per day.

    `mode="overwrite"` replaces only the days present in `df`. The rebalance
    hint lets adaptive execution split a busy day over many files; rows are in
    time order inside a file, so a short window skips most row groups.
    """
    time = schemas.TIME_COLUMN[name]
    dated, changed = noting(shape(df, name).withColumn("ts_date", F.to_date(time)))
    (
        dated.hint("rebalance", F.col("ts_date"))
        .sortWithinPartitions("ts_date", time)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ts_date")
        .parquet(f"{folder}/{name}")
    )
    note_days(df.sparkSession, name, folder, changed())


def noting(dated: DataFrame):
    """`dated`, and a function that tells the days of `ts_date` once it has been written; no pass of its own."""
    seen = Observation()
    day = F.coalesce(F.col("ts_date").cast("string"), F.lit(""))
    dated = dated.observe(seen, F.collect_set(day).alias("days"))

    def changed() -> list:
        # A plan that Spark finds empty loses the observation, and Observation.get fails.
        return [day or None for day in seen.get["days"]] if seen._jo.getRow().length() else []

    return dated, changed


def note_days(spark: SparkSession, name: str, folder: str, days: list) -> None:
    """Note that these days of a table changed, None for rows without a time.

    Called after a write. A writer that fails in between has to be run again anyhow, and notes its days then.
    """
    if days:
        rows = spark.createDataFrame([(day and str(day),) for day in days], "day string")
        notes = rows.select(F.col("day").cast("date").alias("ts_date"), F.lit(1).cast("long").alias("notes"))
        notes.coalesce(1).write.mode("append").parquet(f"{folder}/{NOTES}/{name}")
