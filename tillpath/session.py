"""Session settings and the two ways this library cuts a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tillpath", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC dates and adaptive plans.

    Shuffle partitions are left to the caller; with adaptive execution a generous number is
    coalesced at run time, so set it for the largest shuffle.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _base_folder(spark: SparkSession) -> str:
    """What the cluster names in `spark.checkpoint.dir`; a local session without it gets a temporary folder.

    On a cluster a folder of one machine would be lost with it, so the missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tillpath-")
    return folder


_LOCAL: dict[str, str] = {}
# The folders of the scopes that are open, the innermost last.
_SCOPES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: that of the innermost open `scope`, else one of this session."""
    if _SCOPES:
        return _SCOPES[-1]
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    context.setCheckpointDir(_base_folder(spark))
    return context.getCheckpointDir()


def _storage(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of a job, on whatever storage Spark has it; nothing if it is not there."""
    files, place = _storage(spark, path)
    files.delete(place, True)


def create_empty(spark: SparkSession, path: str) -> None:
    """Create an empty file that must not exist yet."""
    files, place = _storage(spark, path)
    files.create(place, False).close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; FileNotFoundError without the folder."""
    files, place = _storage(spark, path)
    if not files.exists(place):
        raise FileNotFoundError(path)
    return [f.getPath().toString() for f in files.listStatus(place)]


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Owns every table and checkpoint that `stage` and `cut` write inside it and removes them at its end, after an error too.

    What leaves the scope must be written elsewhere first (or collected): a frame that reads its tables cannot
    be computed any more. Scopes may be nested; they belong to the driver thread's work, one after the other.
    """
    outer = shared_folder(spark)
    context = spark.sparkContext
    # Beside the session's own folder, wherever that was set.
    above = _SCOPES[-1] if _SCOPES else os.path.dirname(outer)
    own = os.path.join(above, f"scope-{uuid.uuid4().hex}")
    context.setCheckpointDir(own)
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.pop()
        remove(spark, own)
        # Spark makes a new folder below the one it is given; what the outer one holds stays where it is.
        context.setCheckpointDir(above)
        if not _SCOPES and not listed(spark, outer):
            remove(spark, outer)


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it on shared storage, with its row order and partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# From Spark 4.1 on, a write that runs under it removes its own shuffle files when it is done.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Preferred to `cut` for wide frames with several readers: each reader prunes columns and pushes
    filters down. Nothing reads the shuffles of the write again, so they do not stay on the disks
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """A report of a few rows as it is now, independent of the tables it was computed from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
