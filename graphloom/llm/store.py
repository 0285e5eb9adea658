"""Tables in the folder that all executors share, to cut lineage and to reuse costly results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written since the innermost ``settled`` began.
_since: ContextVar[list[str] | None] = ContextVar("_since", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on one machine, where the session names none, a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphloom.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.dir", place)
    return place.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return path


def remove(spark: SparkSession, path: str) -> None:
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).delete(handle, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    if (since := _since.get()) is not None:
        since.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; the tables written on the way to it are removed, as nothing reads them any more."""
    outer, own = _since.get(), []
    token, kept = _since.set(own), None
    try:
        found = written(make(), name)
        kept = own[-1]
    finally:
        _since.reset(token)
        for path in own:
            if path != kept:
                remove(spark, path)
    if outer is not None:
        outer.append(kept)
    return found


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``written`` returned and that nothing will read."""
    for df in tables:
        if place := path_of(df):
            remove(df.sparkSession, place)


def path_of(df: DataFrame) -> str:
    """The folder of a table that ``written`` returned."""
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""
