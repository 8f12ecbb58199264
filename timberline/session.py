"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_OPEN = threading.local()
# shuffle files of a finished execution go at once instead of with the driver's garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "timberline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        # log time is epoch seconds in UTC
        "spark.sql.session.timeZone": "UTC",
        # run-time coalescing, broadcast conversion and splitting of hot join keys
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session without the setting gets its own folder; on a cluster the setting is
    required, since a machine-local folder would be lost with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="timberline-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/timberline/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it is done."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "step", stay: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table: a cut lineage that survives executors.

    Inside ``passing`` the table goes when that ends; with ``stay`` it outlives it, until the one around it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    scopes = getattr(_OPEN, "scopes", [])
    if len(scopes) > stay:
        scopes[-1 - stay].append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def release(*tables: DataFrame, always: bool = False) -> None:
    """Delete tables that ``materialize`` gave before ``passing`` ends; those outside of it stay, unless ``always``."""
    for table in tables:
        held = [scope for scope in getattr(_OPEN, "scopes", []) if table._scratch in scope]
        for scope in held:
            scope.remove(table._scratch)
        if held or always:
            discard(table.sparkSession, table._scratch)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end; no DataFrame that reads them may be used after it."""
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), []]
    try:
        yield
    finally:
        *_OPEN.scopes, written = _OPEN.scopes
        for path in written:
            discard(spark, path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    if "/timberline/" not in path:
        raise ValueError(f"{path} is not below the scratch folder")
    drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark knows."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system Spark knows is there."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, place = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of fewer splits than cores one partition per core; leave others as they are.

    Splits are of ``spark.sql.files.maxPartitionBytes``, so only a table of less than that for each
    core is dealt out; a large one is read where it lies, however few its files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
