"""Session settings and the one place that decides where scratch tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest join side, in bytes, that an operator may mark for broadcast.
BROADCAST_LIMIT = 256 * 1024 * 1024


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_SCRATCH: dict[str, str] = {}
_REMOVED_AT_EXIT: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` of the session, or the checkpoint
    folder set on its context.

    Only a ``local[*]`` master may fall back to a folder on this machine; on a
    cluster such a folder would vanish with its host, so a missing setting is an error. The folder of an
    application is removed when its driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app_id = spark.sparkContext.applicationId
    if shared:
        return _removed_at_exit(spark, f"{shared.rstrip('/')}/gridloom-{app_id}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if app_id not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app_id] = tempfile.mkdtemp(prefix="gridloom-")
    return _removed_at_exit(spark, _LOCAL_SCRATCH[app_id])


def _removed_at_exit(spark: SparkSession, root: str) -> str:
    """Create the folder and have the driver's file system client delete it when the application ends."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None and root not in _REMOVED_AT_EXIT:
        path = jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _REMOVED_AT_EXIT.add(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own for one written table or one stream."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as Spark itself resolves it: for tasks that open files through another client."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = store.makeQualified(place).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Used where a result must not change if a lost executor is recomputed (values
    that depend on the partition layout). Columnar, so later passes read only the
    columns they use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` that nothing reads again (all that reads them is written, too)."""
    for table in tables:
        spark = table.sparkSession
        owner = scratch_root(spark).rstrip("/").rsplit("/", 1)[1]
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if folder.split("/")[-2] == owner:  # never anything but a scratch table of this application
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast when its known size stays under ``limit``.

    Beyond the limit the join is left to Spark (shuffle join, AQE skew handling),
    with the same result.
    """
    return F.broadcast(df) if rows * row_bytes <= limit else df
