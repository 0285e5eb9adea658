"""Equi-joins that stay even when one key holds a third of the rows.

A key is heavy if it has more than one in ``SHARE`` of all rows, so there are fewer than ``SHARE`` heavy keys
however large the table is; this is what bounds the list of them that is broadcast. Rows of a heavy key are dealt
over ``PARTS`` tasks, and the row that they meet is repeated for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, PARTS = 2000, 64
#: A key with fewer rows than this burdens no task.
LEAST = 2000


def heavy_of(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` (one a key, ``n`` rows each) whose key is heavy among ``total`` rows."""
    return counts.filter(F.col(n) > max(LEAST, total // SHARE))


def join(many: DataFrame, one: DataFrame, keys: Sequence[str], heavy: DataFrame, spread: Sequence[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """``many`` joined with ``one`` on ``keys``; ``spread`` are columns of ``many`` that differ among the rows of a key.

    ``heavy`` holds the heavy keys of ``many`` (see ``heavy_of``) with any other columns. Null keys match nothing.
    With ``hint`` both sides are shuffled at any size. The plan is the same whether there are heavy keys or not.
    """
    side = lambda df: df.hint("merge") if hint else df
    schema = heavy.select(*keys).schema
    few = [tuple(r) for r in heavy.select(*keys).collect()]  # fewer than SHARE rows
    # a row of nulls, which matches nothing, keeps the table from being empty and the join in the plan
    table = many.sparkSession.createDataFrame([*few, (None,) * len(keys)], "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema) + ">")
    table = F.broadcast(table.withColumn("__heavy", F.lit(True)))
    dealt = many.join(table, list(keys), "left").withColumn("__part", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))).drop("__heavy")
    all_parts = F.sequence(F.lit(0), F.when(F.col("__heavy"), F.lit(PARTS - 1)).otherwise(F.lit(0)))
    copied = one.join(table, list(keys), "left").withColumn("__part", F.explode(all_parts)).drop("__heavy")
    return dealt.join(side(copied), [*keys, "__part"], how).drop("__part")
