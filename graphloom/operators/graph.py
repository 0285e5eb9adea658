"""The reference graph: neighbours, roots, leaves, bounded closure, cycles, lineages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.plans.settle import settled


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Several references between two objects are one edge."""
    return edges.select("src", "dst").distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no resolved edge enters; a loop enters its own node."""
    return nodes.select("address").join(edges.select(F.col("dst").alias("address")), "address", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no resolved edge leaves."""
    return nodes.select("address").join(edges.select(F.col("src").alias("address")), "address", "left_anti")


def coverage(nodes: DataFrame, facts: DataFrame, all_sources: int) -> DataFrame:
    """Sources there are and were scanned, nodes, facts, and whether that is all."""
    n = nodes.agg(F.countDistinct("source").alias("scanned_sources"), F.count("*").alias("indexed_nodes"))
    f = facts.agg(F.count("*").alias("fact_count"))
    return n.join(F.broadcast(f)).select(F.lit(all_sources).cast("long").alias("total_sources"), "scanned_sources", "indexed_nodes", "fact_count", (F.col("scanned_sources") == all_sources).alias("complete"))


def closure(edges: DataFrame, start: DataFrame, max_depth: int | None = None, reverse: bool = False, every: int = 4) -> DataFrame:
    """(address, depth) of what can be reached from ``start`` (roots at depth 0), breadth first.

    Each round joins the last level with the edges and leaves out what was seen, so a round's work follows the
    frontier. Lineage is cut every few rounds, in the folder that executors share.
    """
    step = edges.select(F.col("dst" if reverse else "src").alias("address"), F.col("src" if reverse else "dst").alias("next")).distinct()
    level = start.select("address").distinct().withColumn("depth", F.lit(0))
    seen, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = level.join(step, "address").select(F.col("next").alias("address")).distinct().join(seen.select("address"), "address", "left_anti")
        level = settled(found.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if depth % every == 0:
            seen = settled(seen)
    return seen


@dataclass
class Traversal:
    """What a bounded traversal reached, how many edges it looked at, and which of its limits left something out."""

    nodes: DataFrame
    edges_examined: int
    depth_limited: bool = False
    nodes_limited: bool = False
    edges_limited: bool = False

    @property
    def truncated(self) -> bool:
        return self.depth_limited or self.nodes_limited or self.edges_limited


def traverse(edges: DataFrame, start: DataFrame, reverse: bool = False, max_depth: int | None = None, max_nodes: int | None = None, max_edges: int | None = None) -> Traversal:
    """Breadth first from ``start`` until a limit is met; levels beyond it are never computed.

    Roots are made distinct and count as nodes. Edges out of a level are taken in the order (source, target), every
    one that is looked at counts, and new nodes are taken by address.
    """
    step = edges.select(F.col("dst" if reverse else "src").alias("address"), F.col("src" if reverse else "dst").alias("next"))
    out = Traversal(start.limit(0).select("address").withColumn("depth", F.lit(0)), 0)
    level = settled(canonical_roots(start, max_nodes).withColumn("depth", F.lit(0)))
    reached = level.count()
    out.nodes_limited = max_nodes is not None and start.select("address").distinct().count() > max_nodes
    seen, depth = level, 0
    while not level.isEmpty():
        taken = level.select("address").join(step, "address")
        if max_depth is not None and depth >= max_depth:
            out.depth_limited = not taken.join(seen.select(F.col("address").alias("next")), "next", "left_anti").isEmpty()
            break
        depth += 1
        if max_edges is not None:
            left = max_edges - out.edges_examined
            taken = settled(taken.orderBy("address", "next").limit(left + 1))
            n = taken.count()
            if n > left:
                out.edges_limited, n = True, left
                taken = taken.orderBy("address", "next").limit(left)
        else:
            taken = settled(taken)
            n = taken.count()
        out.edges_examined += n
        fresh = taken.select(F.col("next").alias("address")).distinct().join(seen.select("address"), "address", "left_anti")
        if max_nodes is not None:
            fresh = settled(fresh.orderBy("address").limit(max_nodes - reached + 1))
            if fresh.count() > max_nodes - reached:
                out.nodes_limited = True
                fresh = fresh.orderBy("address").limit(max_nodes - reached)
        level = settled(fresh.withColumn("depth", F.lit(depth)))
        reached += level.count()
        seen = seen.unionByName(level)
        if depth % 4 == 0:
            seen = settled(seen)
        if out.edges_limited or out.nodes_limited:
            break
    out.nodes = seen
    return out


def canonical_roots(start: DataFrame, most: int | None = None) -> DataFrame:
    """The roots of a traversal: distinct, the least ones if there are more than ``most``."""
    roots = start.select("address").distinct()
    return roots if most is None else roots.orderBy("address").limit(most)


def limited_closure(edges: DataFrame, start: DataFrame, max_nodes: int, max_depth: int | None = None) -> DataFrame:
    """The first ``max_nodes`` nodes by (depth, address), with truncated: whether more were reached."""
    found = traverse(edges, start, max_depth=max_depth, max_nodes=max_nodes)
    return found.nodes.withColumn("truncated", F.lit(found.nodes_limited))


def build(nodes: DataFrame, facts: DataFrame, max_nodes: int | None = None, max_facts: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Nodes and facts in canonical order up to their caps, facts once by (src, field_path, target), and what was left out."""
    facts = facts.dropDuplicates(["src", "field_path", "target"])
    left = {}
    for name, most, order in (("nodes", max_nodes, ["address"]), ("facts", max_facts, ["src", "field_path", "target"])):
        if most is None:
            continue
        df = nodes if name == "nodes" else facts
        left[name] = max(0, df.count() - most)
        if name == "nodes":
            nodes = df.orderBy(*order).limit(most)
        else:
            facts = df.orderBy(*order).limit(most)
    return nodes, facts, left


def scan_once(sources: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scan`` of each distinct content, given back to every source that has it. sources: source, fingerprint, content; scan keeps fingerprint."""
    distinct = sources.groupBy("fingerprint").agg(F.first("content").alias("content"))
    return sources.select("source", "fingerprint").join(scan(distinct), "fingerprint")


def identity_index(sources: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three look-up tables: sources by normalised path and base name, by claimed GUID, and each source's folder."""
    path = text.external_path(F.col("path"))
    paths = sources.select("source", path.alias("claim"), text.file_name(path).alias("base"))
    parents = sources.select("source", F.regexp_replace(path, r"/?[^/]*$", "").alias("parent"))
    return paths, claims.select("guid", "source").distinct(), parents


def unique_path_source(paths: DataFrame) -> DataFrame:
    """(claim, source) of the paths that exactly one source claims."""
    return paths.groupBy("claim").agg(F.min("source").alias("source"), F.countDistinct("source").alias("_n")).filter("_n = 1").drop("_n")


def adjacency(edges: DataFrame, folder: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """The edges written twice, dealt and sorted by either end, so that both directions read only their own files."""
    spark = edges.sparkSession
    both = []
    for end in ("src", "dst"):
        place = f"{folder}/by-{end}"
        own = distinct_edges(edges).withColumn("bucket", F.pmod(F.xxhash64(end), F.lit(buckets)))
        own.repartition(buckets, "bucket").sortWithinPartitions(end).write.partitionBy("bucket").parquet(place)
        both.append(spark.read.parquet(place))
    return both[0], both[1]


#: Edges that one task takes to find the components of what is left.
WITHIN = 500_000


def _trim(edges: DataFrame, layers: int = 3) -> DataFrame:
    """Drops edges whose ends can't lie on a cycle: no way in to the source, or none out of the target; some layers a job."""
    now, count = edges, edges.count()
    while count:
        for _ in range(layers):
            now = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now = settled(now)
        left = now.count()
        if left == count or left <= WITHIN:
            break
        count = left
    return now


def _strong(src: list, dst: list) -> list[tuple[str, str]]:
    """(component, node) of the strongly connected components of several nodes, by one depth-first walk without recursion."""
    out: dict = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict = {}
    low: dict = {}
    stack, on, found = [], set(), []
    for root in out:
        if root in order:
            continue
        work = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    own = []
                    while True:
                        own.append(stack.pop())
                        on.discard(own[-1])
                        if own[-1] == node:
                            break
                    if len(own) > 1:
                        least = min(own)
                        found += [(least, x) for x in own]
    return found


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src, dst = [], []
    for batch in batches:
        src += batch.column(0).to_pylist()
        dst += batch.column(1).to_pylist()
    found = _strong(src, dst)
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["component", "address"])


def cycles(edges: DataFrame) -> DataFrame:
    """(component, address): strongly connected components of several nodes, or of one with a loop; named by their least node.

    Nodes that can't lie on a cycle are trimmed. While more than ``WITHIN`` edges are left, the least node that
    reaches a node is propagated forwards, a node also taking the label of its label, so that rounds follow the
    logarithm of a chain's length; of each such class, what reaches its least node backwards is one component, and
    the rest goes on. What is left at last is walked by one task.
    """
    edges = settled(distinct_edges(edges))
    loops = edges.filter("src = dst").select(F.col("src").alias("component"), F.col("src").alias("address"))
    rest, out = _trim(edges.filter("src <> dst")), loops.limit(0)
    while (n := rest.count()) > WITHIN:
        found, rest = _one_round(rest)
        out = out.unionByName(found)
        rest = _trim(rest)
    if n:
        out = out.unionByName(settled(rest.select(F.col("src").cast("string"), F.col("dst").cast("string")).coalesce(1).mapInArrow(_within, "component string, address string")))
    return out.unionByName(loops.join(out.select("address"), "address", "left_anti").select("component", "address"))


def _one_round(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the least nodes of all classes, and the edges that are left for further rounds."""
    nodes = rest.select(F.col("src").alias("address")).union(rest.select(F.col("dst").alias("address"))).distinct()
    label = settled(nodes.withColumn("label", F.col("address")))
    while True:
        sent = rest.join(label.withColumnRenamed("address", "src"), "src").groupBy(F.col("dst").alias("address")).agg(F.min("label").alias("sent"))
        then = label.join(sent, "address", "left").select("address", F.least("label", "sent").alias("then"), "label")
        upper = then.select(F.col("address").alias("then"), F.col("then").alias("upper"))
        then = settled(then.join(upper, "then", "left").select("address", F.least("then", "upper").alias("then"), "label"))
        moved = then.filter("then <> label")
        label = then.select("address", F.col("then").alias("label"))
        if moved.isEmpty():
            break
    inner = rest.join(label.withColumnsRenamed({"address": "src", "label": "a"}), "src").join(label.withColumnsRenamed({"address": "dst", "label": "b"}), "dst").filter("a = b").select("src", "dst", F.col("a").alias("label"))
    inner = settled(inner)
    reached = label.filter("address = label").select("address", "label")
    front = reached
    while True:
        back = inner.join(front.withColumnRenamed("address", "dst"), ["dst", "label"]).select(F.col("src").alias("address"), "label").distinct()
        front = settled(back.join(reached, ["address", "label"], "left_anti"))
        if front.isEmpty():
            break
        reached = settled(reached.unionByName(front))
    size = reached.groupBy("label").count().filter("count > 1").select("label")
    found = settled(reached.join(size, "label").select(F.col("label").alias("component"), "address"))
    done = reached.select("address")
    left = inner.select("src", "dst").join(done.withColumnRenamed("address", "src"), "src", "left_anti").join(done.withColumnRenamed("address", "dst"), "dst", "left_anti")
    return found, settled(left)


def least_cycles(components: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The nodes of the ``most`` least components, by their sorted nodes, and whether there are more.

    Components share no node, so the order of their sorted nodes is that of their least ones, by which they are named.
    """
    names = components.select("component").distinct().orderBy("component").limit(most + 1).collect()
    kept = [r.component for r in names[:most]]
    return components.filter(F.col("component").isin(kept)), len(names) > most


def lineages(parents: DataFrame, names: DataFrame, max_depth: int = 128) -> DataFrame:
    """(address, path, cyclic): names from the top to each node, joined by slashes, one parent a node.

    A chain that meets itself or goes deeper than ``max_depth`` is cyclic and has no path. Every round joins each
    node's chain with that of the node above it, so chains double in length and rounds follow the logarithm of the depth.
    """
    nodes = names.select("address").union(parents.select("address")).union(parents.select(F.col("parent").alias("address"))).filter("address is not null").distinct()
    named = nodes.join(names.select("address", F.col("name").alias("path")), "address", "left")
    state = settled(named.join(parents.select("address", F.col("parent").alias("top")), "address", "left").withColumn("hops", F.lit(1)))
    while not state.filter((F.col("top").isNotNull()) & (F.col("hops") <= max_depth)).isEmpty():
        upper = state.select(F.col("address").alias("top"), F.col("path").alias("_path"), F.col("top").alias("_top"), F.col("hops").alias("_hops"))
        step = state.join(upper, "top", "left").withColumn("_far", F.col("hops") + F.coalesce("_hops", F.lit(0)))
        over = (F.col("_far") > max_depth) | (F.col("hops") > max_depth)
        # a chain that is too long keeps its top, so that it shows as one, but no text
        state = settled(step.select("address", F.when(~over, F.concat_ws("/", "_path", "path")).alias("path"), F.when(over, F.coalesce("_top", "top")).otherwise(F.col("_top")).alias("top"), F.when(over, max_depth + 1).otherwise(F.col("_far")).cast("int").alias("hops")))
    cyclic = F.col("hops") > max_depth
    return state.join(names.select("address"), "address", "left_semi").select("address", F.when(~cyclic, F.col("path")).alias("path"), cyclic.alias("cyclic"))


def reparent_check(parents: DataFrame, moves: DataFrame) -> DataFrame:
    """(address, new_parent, rejected): a move under the node itself or one of its descendants is rejected."""
    up = closure_up(parents, moves.select(F.col("new_parent").alias("address")).distinct())
    hit = moves.join(up.withColumnsRenamed({"start": "new_parent", "above": "address"}), ["new_parent", "address"], "left_semi").select("address", "new_parent").withColumn("rejected", F.lit(True))
    return moves.join(hit, ["address", "new_parent"], "left").select("address", "new_parent", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def closure_up(parents: DataFrame, start: DataFrame) -> DataFrame:
    """(start, above): each start with itself and all its ancestors; steps double in length every round."""
    seen = settled(start.select(F.col("address").alias("start"), F.col("address").alias("above")).distinct())
    jump = settled(parents.select(F.col("address").alias("above"), "parent").filter("parent is not null").distinct())
    while True:
        more = settled(seen.join(jump, "above").select("start", F.col("parent").alias("above")).distinct().join(seen, ["start", "above"], "left_anti"))
        if more.isEmpty():
            return seen
        seen = settled(seen.unionByName(more))
        jump = settled(jump.join(jump.select(F.col("above").alias("parent"), F.col("parent").alias("_top")), "parent").select("above", F.col("_top").alias("parent")).distinct())
