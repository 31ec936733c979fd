"""Shared storage: where lineage is cut, and products that are built once."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests and local runs).
LOCAL_DIR = "/tmp/checkpoints/starweave"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one where the session sets none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_DIR)
    return LOCAL_DIR


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make() returns, written; all else that was written on the way is dropped."""
    mark = len(_written)
    out = materialize(make(), tag)
    drop_since(mark, keep=1)
    return out


def written() -> int:
    """A mark for drop_since()."""
    return len(_written)


def drop_since(mark: int, keep: int = 0) -> None:
    """Drops what was written after the mark, but for the last `keep` paths."""
    end = len(_written) - keep
    for spark, path in _written[mark:end]:
        drop_path(spark, path)
    del _written[mark:end]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _sweep() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone already
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
