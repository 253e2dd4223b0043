"""Session setup and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning: coalesce small shuffle partitions, split skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # recording a Python call site per column expression doubles the time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "pickwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = _DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster the
    executors would each write to a disk of their own, so a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="pickwell-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once as Parquet in the shared folder and drop its lineage.

    Used where a costly result is read more than once. The files outlive lost
    executors, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, Spark's batches on their way to Python hold this many rows at most; jobs have to end inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most if int(before) <= 0 else min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
