"""Session settings and the shared folder for data that outlives a stage."""

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pulse", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pulse-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder, so that a lost executor costs no recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of a batch that a task hands to Python at once, where rows are wide.
NARROW_BATCH = 4 << 20


@contextmanager
def narrow_batches(spark: SparkSession, size: int = NARROW_BATCH):
    """Actions inside hand their rows to Python in Arrow batches of about `size` bytes at most; Spark's own bound is 64 MB, held on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def kept_partitions(spark: SparkSession):
    """What is persisted inside keeps the partitions of its plan, so that a join on their key shuffles it no further."""
    name = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffled files of plans that nothing refers to any more.

    It does so once the driver's JVM has collected them, which may take half an hour in a driver with free memory.
    """
    gc.collect()  # what Python still holds of them
    spark._jvm.System.gc()
