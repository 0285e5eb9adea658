"""Projections of the graph to JSON Lines and DOT, with limits that are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import build
from graphloom.plans.settle import settled


def json_lines(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """One typed JSON line a node and fact after a header line: (part, key, line), in the order part, key."""
    head = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(facts.agg(F.count("*").alias("facts"))))
    header = head.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.to_json(F.struct(F.lit("header").alias("record"), F.lit(2).alias("version"), "nodes", "facts")).alias("line"))
    node = nodes.select(F.lit(1).alias("part"), F.col("address").alias("key"), F.to_json(F.struct(F.lit("node").alias("record"), "address", "class_id")).alias("line"))
    fact = facts.select(F.lit(2).alias("part"), F.concat_ws("#", "src", "field_path").alias("key"), F.to_json(F.struct(F.lit("fact").alias("record"), "src", "field_path", "state", "target")).alias("line"))
    return header.unionByName(node).unionByName(fact)


def dot_escape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")


def dot_edges(facts: DataFrame) -> DataFrame:
    """A line of DOT for each resolved fact; other outcomes have no edge."""
    done = facts.filter("state = 'Resolved'")
    return done.select(F.concat(F.lit('  "'), dot_escape(F.col("src")), F.lit('" -> "'), dot_escape(F.col("target")), F.lit('" [label="'), dot_escape(F.col("field_path")), F.lit('"];')).alias("line"))


def write_projection(nodes: DataFrame, facts: DataFrame, form: str, path: str, max_nodes: int | None = None, max_facts: int | None = None) -> dict[str, int]:
    """Writes a graph as json_lines or dot and returns what was left out. Lines stand in order within and across files.

    dot has resolved edges only; json_lines begins with the header, then come nodes, then facts.
    """
    if form not in ("json_lines", "dot"):
        raise ValueError(form)
    nodes, facts, left = build(nodes, facts, max_nodes, max_facts)
    if form == "dot":
        lines = dot_edges(facts).select(F.lit(1).alias("part"), F.col("line").alias("key"), "line")
        ends = nodes.sparkSession.createDataFrame([(0, "", "digraph references {"), (2, "", "}")], "part int, key string, line string")
        lines = ends.unionByName(lines)
    else:
        lines = json_lines(nodes, facts)
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.text(path)
    return left


def limited(df: DataFrame, key: str, limit: int) -> tuple[DataFrame, bool]:
    """The first rows by key, and whether there were more."""
    first = settled(df.orderBy(key).limit(limit + 1))  # limit + 1 rows
    return first.orderBy(key).limit(limit), first.count() > limit


def within_bytes(rows: DataFrame, key: str, line: str, most: int) -> DataFrame:
    """The longest run of a page's rows, by key, whose lines fit ``most`` bytes together. For pages, not tables."""
    running = F.sum(F.octet_length(line)).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", running).filter(F.col("_sum") <= most).drop("_sum")


def compression_stats(blocks: DataFrame, *group: str) -> DataFrame:
    """Sums, ratio (1 for nothing), bytes saved and integer mean (0 for nothing) of compressed blocks."""
    out = blocks.groupBy(*group).agg(F.sum("compressed").alias("compressed"), F.sum("raw").alias("raw"), F.count("*").alias("blocks"))
    ratio = F.when(F.col("raw") == 0, 1.0).otherwise(F.col("compressed") / F.col("raw"))
    mean = F.when(F.col("blocks") == 0, 0).otherwise(F.floor(F.col("compressed") / F.col("blocks")))
    return out.select(*group, "compressed", "raw", "blocks", F.round(ratio, 9).alias("ratio"), (F.col("raw") - F.col("compressed")).alias("saved"), mean.cast("long").alias("average"))


def path_id_summary(objects: DataFrame, *group: str) -> DataFrame:
    """Negative and positive ids, least and greatest."""
    return objects.groupBy(*group).agg(F.count_if(F.col("path_id") < 0).alias("negative"), F.count_if(F.col("path_id") > 0).alias("positive"), F.min("path_id").alias("least"), F.max("path_id").alias("greatest"))
