"""Session helpers: building a local session for tests/bench and locating the
shared folder used for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "prism") -> SparkSession:
    """Session for tests and the local bench. On a cluster the caller's session is used as is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Private folders of local sessions without ``spark.checkpoint.dir`` (tests), by application id.
_LOCAL_DIRS: dict[str, str] = {}
#: Scratch tables written by this process, for :func:`clear_scratch`.
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session and never changed there. Only when it is unset on a local
    master (tests) a private folder is made, so a cluster never falls back to a
    machine-local path.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="prism-ckpt-")
    return _LOCAL_DIRS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for a written intermediate table."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has written; call it when no DataFrame
    built on them is needed any more. Returns how many folders went."""
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back:
    later readers neither recompute its lineage nor lose it with an executor.
    (One job, unlike an unpersisted ``checkpoint()``, which computes twice.)"""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
