"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share and read again; removed when the application ends.

    A checkpoint would keep the size that was estimated for its plan, and in a loop of joins these estimates multiply;
    a table's size is that of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/settled-{uuid.uuid4().hex}"
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if the session runs on one machine, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphloom.settled", None)
    if place:
        return place.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.graphloom.settled", place)
    return place
