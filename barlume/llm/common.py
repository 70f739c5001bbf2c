"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where each written frame lies, as long as someone holds it.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (local tests) a temporary folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barlume-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there and
    the planner knows the size of what follows. A lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[back] = path
    return back


def release(*frames: DataFrame) -> None:
    """Deletes the folders of written frames whose successors are written, and with them the shuffle files of
    finished steps: Spark drops those once the driver's JVM has collected their handles, which is asked for here as
    a driver with a large heap would not collect for hours. Nothing may read the frames any more."""
    for df in frames:
        spark, path = df.sparkSession, _folders.pop(df, None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """A written frame under other column names, still to be released."""
    out = df.toDF(*names)
    if df in _folders:
        _folders[out] = _folders.pop(df)
    return out

