"""Session settings, shared scratch tables and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["build_session", "shared_dir", "stash", "free", "cut"]


def build_session(app: str = "linkwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything already set by the cluster is kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``; a local one only if that is unset and everything is local."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="linkwright-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


_written: list[tuple[SparkSession, str]] = []


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        pass


@atexit.register
def release() -> int:
    """Delete every scratch table this process wrote; returns how many."""
    n = len(_written)
    while _written:
        _drop(*_written.pop())
    return n


def stash(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/linkwright-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._linkwright_path = path
    return out


def free(df: DataFrame) -> None:
    """Delete the scratch table behind a result of ``stash`` that nothing will read again."""
    path = getattr(df, "_linkwright_path", None)
    if path is not None:
        _written[:] = [x for x in _written if x[1] != path]
        _drop(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (for small iterated tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
