"""Exact Jaccard join of word-shingle sets, as connected components.

1. Each text becomes its set of 64-bit shingle hashes. Equal sets are one class with its least id.
2. Candidates come from the prefix filter, which loses no link under any total order of shingles: two sets that
   link share one of their first ``size - least overlap + 1`` members. The order is: shingles of a hash class
   first, rarest first, then all others by hash. Their rarity is counted over all documents, and as the class
   is somewhat larger than a prefix, few others are ever needed. Shingles of one document only are never
   shuffled further; frequent ones come last, so a passage that many documents hold brings none together.
   A member's place in the order bounds the sizes of the sets that may link by it: what stands before it isn't
   shared. So of two sets as large only one member in 12 counts (at 85 %), not one in 7.
3. Classes that share a prefix member, directly or through others, form a block. A block of bounded number and
   weight is one tile. In a larger one, each class is first compared with the least class of each of its prefix
   members, which turns a group of near copies into one component at a cost in proportion to its size. Then the
   block is cut by size bands into parts, and a class goes to the tile of its part and another one only if it
   shares a prefix member with a class of that part, of a size that may link by it and of another component. So
   classes that are only chained by others never meet, and a group that is one component by now doesn't either.
4. In a tile each set has a bitmap of its hashes. Bits of one bitmap that another lacks are members that the
   other set lacks, which bounds the overlap from above; pairs that pass are intersected exactly as sorted
   arrays. Pairs that links already connect are left out, so that a tile returns a spanning forest.
5. Forest edges and equal sets are joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernel, skew, store
from graphloom.llm.components import components

#: Sets and members of a tile's part at most; a larger set is a part of its own.
TILE_SETS, TILE_MEMBERS = 400, 400_000
#: 64-bit words of the signature by which pairs with the least class are weeded out.
WORDS = 8

SKETCH_DDL = "id long, size int, key1 long, key2 long, n_first int, first array<long>, more array<long>"


def prefix_length(size: int, percent: int) -> int:
    """Members of a set of ``size`` of which one must be shared with any set that links with it."""
    return size - (size * percent + 99) // 100 + 1 if size else 0


def _sketch(words: int, percent: int, classes: int) -> Callable:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 512):
                rows = []
                for members in kernel.shingle_sets(column[lo : lo + 512], words):
                    in_class = members % np.uint64(classes) == 0
                    first = members[in_class]
                    need = prefix_length(len(members), percent) - len(first)
                    more = members[~in_class][:need] if need > 0 else members[:0]
                    keys = [int(x) for x in np.array([members.sum(), kernel.mix(members + kernel.BASE).sum()], np.uint64).view(np.int64)]
                    rows.append((len(members), *keys, len(first), first.view(np.int64), more.view(np.int64)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "size", "key1", "key2", "n_first", "first", "more"])

    return sketch


def signature(members: np.ndarray) -> np.ndarray:
    """``WORDS`` times 64 bits, one set for each member by the low bits of its hash."""
    bits = np.zeros(64 * WORDS, bool)
    bits[members & np.uint64(64 * WORDS - 1)] = True
    return np.packbits(bits).view(np.int64)


def _sets(words: int, carry: pa.Schema, signed: bool) -> Callable:
    """Rows (carried columns..., text) become (carried columns..., size, signature if asked for, members)."""
    names = [*carry.names, "size", *(["bits"] if signed else []), "members"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = list(kernel.shingle_sets(part.column(part.num_columns - 1), words))
                own = [pa.array(map(len, found), pa.int32())]
                if signed:
                    own.append(pa.array([signature(m) for m in found], pa.list_(pa.int64())))
                own.append(pa.array([m.view(np.int64) for m in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *own], names=names)

    return sets


def forest_of(ids: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect the sets of a tile as all their links would. Sets of sides 0 and 1 meet; so do those of side 2.

    Sets of one group are connected already and aren't compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    label = np.unique(ids if groups is None else groups, return_inverse=True)[1]
    edges: list[tuple[int, int]] = []
    if label.max() == 0 or (side != 2).all() and side.min() == side.max():
        return edges
    bits = int(min(max(8, math.ceil(math.log2(max(1.0, 4 * float(np.median(size)))))), 13))
    flat = np.zeros((n, 1 << bits), bool)
    flat[np.repeat(np.arange(n), size), np.concatenate(sets) >> np.uint64(64 - bits)] = True
    maps = np.packbits(flat, axis=1).view(np.uint64)
    del flat
    ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    for i in range(n - 1):
        rest = slice(i + 1, n)
        meet = (label[rest] != label[i]) & ((side[rest] != side[i]) | (side[i] == 2))
        meet &= 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
        at = np.flatnonzero(meet) + i + 1
        if not len(at):
            continue
        common = np.bitwise_count(maps[at] & maps[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(size[i] - ones[i] + common, size[at] - ones[at] + common)
        for j in at[100 * most >= percent * (size[i] + size[at] - most)].tolist():
            if label[j] == label[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (size[i] + size[j] - shared):
                edges.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return edges


def _compare(percent: int) -> Callable:
    """Reads rows (tile, side, id, group, members) that are sorted by tile and yields each tile's forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets, sides, groups = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                edges = forest_of(ids, sets, np.array(sides), percent, groups)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            values = batch.column(4)
            flat, at = values.values.to_numpy().view(np.uint64), values.offsets.to_numpy()
            for k, (key, side, doc, group) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                if key != tile:
                    yield from done()
                    tile, ids, sets, sides, groups = key, [], [], [], []
                ids.append(doc)
                sets.append(flat[at[k] : at[k + 1]].copy())
                sides.append(side)
                groups.append(group)
        yield from done()

    return compare


LINKS_DDL = "u long, v long"


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """The forests of all tiles of rows (tile, side, id, group, members)."""
    return rows.repartition("tile").sortWithinPartitions("tile", "side").select("tile", "side", "id", "group", "members").mapInArrow(kernel.task(_compare(percent)), LINKS_DDL)


def _prefix(size: Column, percent: int) -> Column:
    return size - F.floor((size * percent + 99) / 100) + 1


def _most(size: Column, before: Column, percent: int) -> Column:
    """The size of the largest set that may link with one of ``size`` if none of the first ``before`` members is shared."""
    return (F.floor((100 + percent) * (size - before).cast("long") / percent) - size).cast("int")


def _that_meet(prefix: DataFrame) -> DataFrame:
    """The rows of a prefix (id, h, size, most) by which sets may meet, with ``v``, a set that all others of a member may be tied to.

    Two sets whose first shared member is ``h`` link only if neither is larger than the other one's ``most``. So the
    smaller one's isn't less than its own size, and a member that no set holds like this brings none together.
    """
    own = F.col("most") >= F.col("size")
    held = prefix.groupBy("h").agg(F.min(F.when(own, F.col("id"))).alias("v"), F.min("size").alias("low"), F.max("most").alias("far"), F.count("*").alias("n"))
    held = store.written(held.filter("n > 1"), "centres")  # those without v, too, as their rows may be many
    joined = skew.join(prefix, held.filter("v is not null").select("h", "v", "low", "far"), ["h"], skew.heavy_of(held, prefix.count()), ["id"])
    found = store.written(joined.filter("low <= most and size <= far").drop("low", "far"), "prefixes-that-meet")
    store.drop(held)
    return found


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("weight"))


def _first_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the first pairs, checked exactly."""
    spark = pairs.sparkSession
    light = sets.select("id", "size", "bits")
    # weigh pairs by their signatures: bits that the other lacks are members that it lacks
    met = pairs.join(light, "id")
    by_centre = pairs.groupBy("v").agg(F.count("*").alias("n"))
    met = skew.join(met, light.select(F.col("id").alias("v"), F.col("size").alias("size2"), F.col("bits").alias("bits2")), ["v"], skew.heavy_of(by_centre, pairs.count()), ["id"])
    lacks = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(WORDS)])
    most = F.least(F.col("size") - lacks("bits", "bits2"), F.col("size2") - lacks("bits2", "bits"))
    near = store.written(met.filter(100 * most >= percent * (F.col("size") + F.col("size2") - most)).select("id", "v", "size"), "first-near")
    room = near.groupBy("v").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    room = room.select("v", "n", F.ceil(F.greatest(F.col("n") / TILE_SETS, F.col("weight") / TILE_MEMBERS)).alias("parts"))
    placed = skew.join(near, room.select("v", "parts"), ["v"], skew.heavy_of(room, near.count()), ["id"])
    tile = lambda part: F.concat_ws(":", F.lit("first"), "v", part.cast("string"))
    rows = placed.select("id", tile(F.pmod(F.xxhash64("id"), "parts")).alias("tile"), F.lit(1).alias("side"))
    rows = rows.union(room.select(F.col("v").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "v").select("id", tile(F.col("part")), F.lit(0)))
    rows = rows.join(sets.select("id", "members"), "id").withColumn("group", F.col("id"))
    return store.written(_links(rows, percent), "first-links") if room.take(1) else spark.createDataFrame([], LINKS_DDL)


def _parts(big: DataFrame) -> DataFrame:
    """(id, size, group, band, part, pure): parts of one size band and bounded number and weight, pure ones of one component.

    Classes that are no large component lie together if they have the same ``near``, the least class that any of their
    prefix members leads to, so that the classes of a prefix member lie in few parts.
    """
    left = store.written(big, "placed")
    total, made = left.count(), []
    room = lambda share: F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(F.col("n") / (TILE_SETS * share), F.col("weight") / (TILE_MEMBERS * share))))
    large = (F.col("n") > TILE_SETS / 2) | (F.col("weight") > TILE_MEMBERS / 2)
    for key, pure in (("group", True), ("near", False)):
        keys = [key, "band"]
        own = store.written(_counted(left, keys).select(*keys, "n", room(1.0).alias("own"), large.alias("large")), "large-" + key)
        marked = store.written(skew.join(left, own.drop("n"), keys, skew.heavy_of(own, total), ["id"]), "marked")
        part = F.xxhash64(F.lit(key), *keys, F.pmod(F.xxhash64("id"), "own"))
        made.append(marked.filter("large").select("id", "size", "group", "band", part.alias("part"), F.lit(pure).alias("pure")))
        left = marked.filter("not large").drop("own", "large")
    mixed = store.written(_counted(left, ["block", "band"]).select("block", "band", "n", room(0.5).alias("shared")), "mixed")
    rest = skew.join(left, mixed.drop("n"), ["block", "band"], skew.heavy_of(mixed, total), ["id"])
    made.append(rest.select("id", "size", "group", "band", F.xxhash64(F.lit("mixed"), "block", "band", F.pmod(F.xxhash64("near"), "shared")).alias("part"), F.lit(False).alias("pure")))
    return reduce(DataFrame.union, made)


def _tiles(parts: DataFrame, prefix: DataFrame) -> DataFrame:
    """(tile, side, id, group): each class in every tile in which it may meet one that shares a prefix member."""
    held = store.written(prefix.join(parts.select("id", "group", "part", "pure"), "id"), "part-members")
    apart = F.when(F.col("pure"), F.col("group"))
    others = held.groupBy("h", F.col("part").alias("part2"), apart.alias("group2")).agg(F.min("size").alias("low"), F.max("most").alias("far"))
    heavy = skew.heavy_of(held.groupBy("h").agg(F.count("*").alias("n")), held.count())
    met = skew.join(held, others, ["h"], heavy, ["id"]).filter("low <= most and size <= far and (part <> part2 or not pure) and (not pure or group2 is null or group <> group2)")
    met = met.select("id", "group", "part", "part2").distinct()
    side = F.when(F.col("part") == F.col("part2"), 2).when(F.col("part") < F.col("part2"), 0).otherwise(1)
    return met.select(F.concat_ws(":", F.least("part", "part2").cast("string"), F.greatest("part", "part2").cast("string")).alias("tile"), side.alias("side"), "id", "group")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set and the least id that links reach.

    Two texts link if 100 * shared >= percent * united over their sets of lower-cased ``words``-word shingles
    (a text with fewer words has its whole sequence as the one member). Null, empty and blank texts have no
    members and link with nothing. Rows of one id are one node, which has the links of all their texts; a row
    without an id has a null component and links with nothing. An empty table gives no rows. Other columns of
    ``df``, whatever their names, aren't returned. Texts of any length are whole sets; ties don't occur, as a
    component's id is its least one. Of the tables written on the way only the result stays.
    """
    return store.settled(df.sparkSession, "jaccard-components", lambda: _jaccard_components(df, id_col, text_col, words, percent))


def _jaccard_components(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    classes = max(1, int(1 / (1.3 * (1 - percent / 100)))) if percent < 100 else 64
    sketch = store.written(docs.mapInArrow(kernel.task(_sketch(words, percent, classes)), SKETCH_DDL), "shingles")
    known = sketch.filter("id is not null and size > 0")

    keys = ["key1", "key2", "size"]
    least = store.written(known.groupBy(*keys).agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "equal-sets")
    same = skew.join(known.select("id", *keys), least.drop("n"), keys, skew.heavy_of(least, sketch.count()), ["id"])
    copies = store.written(same.filter("id <> least").select("id", "key1", "least").distinct(), "copies")

    members = known.select("id", "key1", "size", "n_first", F.explode("first").alias("h"))
    shared = store.written(members.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shared-shingles")
    heavy = skew.heavy_of(shared, known.agg(F.coalesce(F.sum("n_first"), F.lit(0))).first()[0])
    own = F.sort_array(F.collect_list(F.struct("n", "h"))).alias("own")
    rare = skew.join(members, shared.select("h", "n"), ["h"], heavy, ["id"]).groupBy("id", "key1", "size", "n_first").agg(own)
    take = F.greatest(F.lit(0), _prefix(F.col("size"), percent) - F.col("n_first") + F.size("own")).cast("int")
    # copies are left out while a row is a class, before it becomes a row a member
    before = (F.col("n_first") - F.size("own")).alias("before")  # members of one document only are the rarest
    chosen = rare.select("id", "key1", "size", before, F.transform(F.slice("own", F.lit(1), take), lambda m: m["h"]).alias("hs")).union(known.select("id", "key1", "size", "n_first", F.col("more").alias("hs")))
    chosen = chosen.filter(F.size("hs") > 0).join(copies.select("id", "key1").distinct(), ["id", "key1"], "left_anti")
    ranked = chosen.select("id", "size", "before", F.posexplode("hs").alias("at", "h"))
    ranked = store.written(ranked.select("id", "h", "size", _most(F.col("size"), F.col("before") + F.col("at"), percent).alias("most")), "prefixes")
    sizes = store.written(sketch.select("id", "size"), "sizes")
    store.drop(sketch, shared, least)
    prefix = _that_meet(ranked)
    store.drop(ranked)
    edges = prefix.filter("id <> v")
    blocks = components(edges.select(F.col("id").alias("u"), "v"), "blocks").select(F.col("node").alias("id"), F.col("component").alias("block"))
    weights = sizes.filter("id is not null and size > 0").groupBy("id").agg(F.sum("size").cast("int").alias("size"))
    blocks = store.written(blocks.join(weights, "id"), "blocks")

    counts = store.written(_counted(blocks, ["block"]).select("block", "n", ((F.col("n") <= TILE_SETS) & (F.col("weight") <= TILE_MEMBERS)).alias("whole")), "block-sizes")
    placed = store.written(skew.join(blocks, counts.drop("n"), ["block"], skew.heavy_of(counts, blocks.count()), ["id"]), "placed")

    def sets_of(rows: DataFrame, signed: bool) -> DataFrame:
        # texts are shuffled at any size: a broadcast of the candidates would hold only as long as there are few
        joined = docs.join(rows.hint("merge"), "id").select(*rows.columns, "text")
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        carry = pa.schema([(c, pa.int64()) for c in rows.columns])
        return joined.mapInArrow(kernel.task(_sets(words, carry, signed)), f"{ddl}, size int, {'bits array<long>, ' if signed else ''}members array<long>")

    small = sets_of(placed.filter("whole").select("id", "block"), False)
    small = small.select(F.col("block").cast("string").alias("tile"), F.lit(2).alias("side"), "id", F.col("id").alias("group"), "members")
    links = [store.written(_links(small, percent), "links")]
    big = placed.filter("not whole").select("id", "block", "size")
    if not big.isEmpty():
        links += _large_blocks(big, prefix, store.written(sets_of(big.select("id"), True), "sets"), percent)
    edges = reduce(DataFrame.union, links).union(copies.select(F.col("id").alias("u"), F.col("least").alias("v")))
    found = components(edges, "components")
    return sizes.select("id", F.col("size").cast("long").alias("n_shingles")).join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _large_blocks(big: DataFrame, prefix: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Links that connect the classes of the blocks that are more than one tile."""
    step = -math.log(percent / 100) + 0.01  # a little wider, so that rounding can't part two sets that link
    within = store.written(prefix.join(big.select("id"), "id", "left_semi"), "large-prefixes")
    pairs = store.written(within.filter("id <> v").select("id", "v").distinct(), "first-pairs")
    first = _first_links(pairs, sets, percent)
    near = pairs.groupBy("id").agg(F.least(F.min("v"), F.min("id")).alias("near"))
    groups = components(first, "first-components").select(F.col("node").alias("id"), F.col("component").alias("group"))
    banded = big.join(groups, "id", "left").join(near, "id", "left").withColumns({"group": F.coalesce("group", "id"), "near": F.coalesce("near", "id"), "band": F.floor(F.log(F.col("size").cast("double")) / step)})
    tiles = _tiles(store.written(_parts(banded), "parts"), within)
    return [first, store.written(_links(tiles.join(sets.select("id", "members"), "id"), percent), "links")]
