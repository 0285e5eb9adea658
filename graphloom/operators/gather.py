"""What sets of keys lead to, gathered once a distinct set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_set(owners: DataFrame, keys: Column, values: DataFrame, key: str, merged: Column, name: str) -> DataFrame:
    """``owners`` with ``name``: ``merged`` over the rows of ``values`` whose ``key`` is one of ``keys``; null if there are none.

    Long lists are made and moved once a distinct set of keys and only copied where rows come out: as many owners
    as share a set would carry as many copies through a shuffle.
    """
    rows = owners.withColumn("_set", F.array_sort(F.array_distinct(keys)))
    each = rows.select("_set").distinct().select("_set", F.explode("_set").alias(key))
    found = each.join(values, key).groupBy("_set").agg(merged.alias(name))
    return rows.join(found, "_set", "left").drop("_set")
