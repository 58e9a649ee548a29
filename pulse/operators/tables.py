"""Changes to stored tables: insert, upsert, retention, cascade, JSON columns, snapshots."""

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse import schemas
from pulse.functions.filters import TIME, since
from pulse.session import cut_lineage
from pulse.sources.tables import read_table, shape, write_table


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in `order`; of rows equal there the least by all columns, so a rerun takes the same.

    `row_number() = 1` lets Spark drop all but one row per key and task before
    the shuffle, so a key with very many copies does not land on one task.
    """
    # maps have no order, their JSON has
    ties = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
        for f in df.schema
        if f.name not in keys
    ]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of `batch` whose key `target` lacks; the earliest row of each key wins, then the least by all columns."""
    fresh = first_per_key(batch, keys, order or [TIME])
    return fresh.join(target.select(*keys), keys, "left_anti")


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """`target` after insert-if-absent."""
    return target.unionByName(new_rows(target, batch, keys, order), allowMissingColumns=True)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    update_cols: list[str],
    stamp: Column | None = None,
    stamp_col: str = "updated_at",
) -> DataFrame:
    """`target` after insert-or-update: known keys take `update_cols`, new keys take the whole row.

    With `stamp`, `stamp_col` is set on updated rows only.
    """
    # Markers tell which side a row has, even if its key is NULL.
    old = target.withColumn("_known", F.lit(True)).alias("old")
    new = batch.withColumn("_found", F.lit(True)).alias("new")
    both = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    found, known = (F.col(name).isNotNull() for name in ("new._found", "old._known"))

    def value(name):
        if name in keys:
            return F.coalesce(f"old.{name}", f"new.{name}")
        if name not in batch.columns:
            kept = F.col(f"old.{name}")
        elif name in update_cols:
            kept = F.when(found, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        else:
            kept = F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))
        if stamp is not None and name == stamp_col:
            kept = F.when(found & known, stamp).otherwise(kept)
        return kept

    return both.select(*[value(c).alias(c) for c in target.columns])


def merge_into(batch: DataFrame, name: str, folder: str, update_cols: list[str]) -> None:
    """Insert-or-update `batch` in a stored table; only the days of the batch are read and written.

    A key must stay on its day, as it does if it holds the time column or rows keep their time.
    Of several batch rows with one key the earliest counts.
    """
    keys, time = schemas.KEYS[name], schemas.TIME_COLUMN[name]
    fresh = cut_lineage(first_per_key(shape(batch, name), keys, [time]))
    spark = batch.sparkSession
    if stored_yet(lambda: read_table(spark, name, folder)):
        # One value per day of the batch: literals, so that other days are not listed.
        days = [day for day, in fresh.select(F.to_date(time)).distinct().collect()]
        same_day = F.col("ts_date").isin([day for day in days if day])
        if None in days:
            same_day = same_day | F.col("ts_date").isNull()
        old = shape(read_table(spark, name, folder).filter(same_day), name)
        # The days being replaced are also read, so the new rows are written out first.
        fresh = cut_lineage(upsert(old, fresh, keys, update_cols))
    write_table(fresh, name, folder, mode="overwrite")


def stored_yet(read) -> bool:
    """Whether the path that `read` scans is there; any other fault is raised."""
    try:
        read()
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def drop_expired(spark: SparkSession, name: str, folder: str, as_of, days: int | None = None) -> list[str]:
    """Delete the day folders of a stored table that lie wholly before its time of keeping; their days.

    `apply_retention` leaves out the rest of the day that the limit cuts. Tables without a rule keep all.
    """
    days = schemas.RETENTION_DAYS.get(name) if days is None else days
    if days is None:
        return []
    limit = (datetime.fromisoformat(str(as_of)) - timedelta(days=days)).date().isoformat()
    return _remove(spark, f"{folder}/{name}", lambda day: day[:1].isdigit() and day < limit)


def remove_days(spark: SparkSession, path: str, days) -> list[str]:
    """Delete the folders of these days, None for rows without a time; those that there were."""
    names = {str(day) if day else "__HIVE_DEFAULT_PARTITION__" for day in days}
    return _remove(spark, path, names.__contains__) if names else []


def _remove(spark: SparkSession, path: str, wanted) -> list[str]:
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = table.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for entry in files.listStatus(table):  # one entry per day
        column, _, day = entry.getPath().getName().partition("=")
        if column == "ts_date" and wanted(day):
            files.delete(entry.getPath(), True)
            gone.append(day)
    return sorted(gone)


def apply_retention(df: DataFrame, table: str, as_of=None, days: int | None = None) -> DataFrame:
    """Rows the table still keeps; tables without a rule keep all."""
    days = schemas.RETENTION_DAYS.get(table) if days is None else days
    return df if days is None else since(df, as_of, f"{days} DAYS", schemas.TIME_COLUMN[table])


def cascade_delete(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of `child` whose parent is left, and those that name no parent."""
    kept = child.join(parent.select(key), key, "left_semi").select(*child.columns)
    return kept.unionByName(child.filter(F.col(key).isNull()))


def encode_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def decode_json(df: DataFrame, layouts: dict) -> DataFrame:
    """Parse JSON columns; `layouts` maps a column to its type."""
    return df.withColumns({c: F.from_json(c, layout) for c, layout in layouts.items()})


def publish_snapshot(stats: DataFrame, path: str, as_of, ttl_seconds: int = 60) -> None:
    """Replace the stored one-row JSON record and its expiry."""
    now = F.lit(str(as_of)).cast("timestamp")
    record = stats.select(
        F.to_json(F.struct(*stats.columns, now.alias("last_updated"))).alias("record"),
        (now + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")).alias("expires_at"),
    )
    record.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, as_of, layout: str) -> DataFrame:
    """The stored record if there is one and it has not expired, else one row of zeros."""
    now = F.lit(str(as_of)).cast("timestamp")
    saved = "record string, expires_at timestamp"
    if stored_yet(lambda: spark.read.schema(saved).parquet(path)):
        records = spark.read.schema(saved).parquet(path)
    else:
        records = spark.createDataFrame([], saved)
    stored = (
        records.filter(F.col("expires_at") > now)
        .select(F.from_json("record", layout).alias("stored"), F.lit(1).alias("one"))
    )
    row = spark.range(1).select(F.lit(1).alias("one")).join(stored, "one", "left")
    fields = stored.schema["stored"].dataType.fields
    zero = {"timestamp": now}
    return row.select(
        *[
            F.coalesce(
                F.col(f"stored.{f.name}"), zero.get(f.dataType.simpleString(), F.lit(0)).cast(f.dataType)
            ).alias(f.name)
            for f in fields
        ]
    )
