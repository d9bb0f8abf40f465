"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = threading.local()


def _written() -> list[str]:
    """What this thread has written: jobs in several threads of one driver own their tables apart from each other."""
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of this process; on a cluster that would be a
    folder which other machines cannot read, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder of the shared store, which a ``sweep`` of the same thread will delete."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared store and read it back.

    This cuts the lineage: later stages read committed files, so a lost executor costs a re-read and
    values that depend on task identity cannot change between uses.
    """
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def mark() -> int:
    """A place in the list of what this thread has written, for ``sweep``."""
    return len(_written())


def sweep(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Delete what this thread has written to the store from ``since`` on, but for the tables ``keep``.

    For a step whose result is stored: nothing reads what led to it any more. A lazy result still reads its
    tables; its caller sweeps when it is done with it.
    """
    kept = [k.stored_at for k in keep]
    gc.collect()
    spark._jvm.System.gc()  # Spark deletes shuffle files once the driver's garbage collector has met their plans
    for path in [p for p in _written()[since:] if p not in kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written().remove(path)
