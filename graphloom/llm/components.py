"""Connected components by contraction and alternating large-star and small-star steps, all of it distributed.

Each round is one aggregation and one join for either step; then the edges that lie together in a partition are
contracted, in chunks of bounded size, without a shuffle. The edges of a hub are dealt over many tasks. Rounds end
when the edges are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernel, skew, store

#: Edges that one task contracts together; what it holds is bounded by that.
CHUNK = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of each chunk of a partition by stars around the least nodes that they connect."""
    parts, held = [], 0

    def stars() -> pa.RecordBatch:
        edges = np.concatenate(parts, axis=1)
        nodes, flat = np.unique(edges, return_inverse=True)
        u, v = flat.reshape(2, -1)
        least = np.arange(len(nodes))
        while True:  # hook the larger root to the smaller one, then let all nodes point to their roots
            a, b = least[u], least[v]
            if (a == b).all():
                break
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while (least != (up := least[least])).any():
                least = up
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], names=["u", "v"])

    for batch in batches:
        parts.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        held += batch.num_rows
        if held >= CHUNK:
            yield stars()
            parts.clear()
            held = 0
    if held:
        yield stars()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two centres, or is a centre and a leaf."""
    ends = edges.select(F.col("u").alias("node"), "v").union(edges.select(F.col("v").alias("node"), F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.count("v").alias("out"), F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    return not seen.filter("out > 0 and (out < n or a <> b)").isEmpty()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return skew.join(both.filter("v > u"), least.select("u", "m"), ["u"], skew.heavy_of(least, 2 * total), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = skew.join(down, least.select("u", "m"), ["u"], skew.heavy_of(least, total), ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """For edges (u, v) of integers, (node, component) with the least node of each component.

    Self-loops, repeated edges and nulls are ignored. Nodes without an edge are not listed; the least
    node of a component is listed with itself.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = edges.filter("u is not null and v is not null and u <> v")
    now = store.written(edges.mapInArrow(kernel.task(_contract), "u long, v long"), name)
    while _unsettled(now):
        total = now.count()
        wide = store.written(_large_star(now, total), name)
        then = store.written(_small_star(wide, wide.count()).mapInArrow(kernel.task(_contract), "u long, v long"), name)
        for old in (now, wide):
            if place := store.path_of(old):
                store.remove(spark, place)
        now = then
    now = now.distinct()
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
