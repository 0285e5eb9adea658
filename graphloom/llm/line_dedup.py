"""Line deduplication by pairwise alignment.

Lines without a word play no part; the others are known by a 64-bit hash of their bytes. A run of neighbouring
lines is long enough if one of its lines has ``FULL`` words or all have ``LONG`` words together. A line goes if it
lies in such a run that an earlier text has in a row, too, whatever number of texts hold it.

Every such run is made of short windows: from each line on, and up to each line, the fewest lines that are long
enough. Each window points from every text that holds it to the first of them, so a passage of n texts gives n - 1
pairs and not n squared, and these pairs cover all: whatever an alignment with any other earlier text would delete
consists of windows, each of which the first holder has as well. The two texts of a pair are aligned by patience
diff; aligned blocks that are long enough go from the later one. What is left is aligned again, as blocks may stand
in another order, until nothing more is found; windows that are still left and stand in a row in both go last.
A text that equals an earlier one is one aligned block: it needs no diff.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernel, skew, store

#: A line of so many words, or so many words in a row, is no coincidence.
FULL, LONG = 8, 20
#: Texts that one task aligns with one earlier text at most.
ALIGNED = 1000

LINES_DDL = "id long, key long, n_words long, place array<int>, h array<long>, words array<int>, windows array<long>"


def windows_of(h: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and line after the last of each shortest run that is long enough.

    ``begin`` and ``end`` are, for each line, the first line of its text and the one after its last.
    """
    n, at = len(h), np.arange(len(h))
    total = np.concatenate(([0], np.cumsum(words)))
    full = np.flatnonzero(words >= FULL)
    stop = np.minimum(np.append(full, n)[np.searchsorted(full, at)] + 1, np.searchsorted(total, total[:-1] + LONG))
    start = np.maximum(np.insert(full, 0, -1)[np.searchsorted(full, at, "right")], np.searchsorted(total, total[1:] - LONG, "right") - 1)
    forth, back = stop <= end, start >= begin
    both = np.unique(np.concatenate((at[forth] << 32 | stop[forth], start[back] << 32 | at[back] + 1)))
    first, after = both >> 32, both & 0xFFFFFFFF
    return kernel.SequenceHashes(h).of(first, after), first, after


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.texts_of(batch.column(2))
        for lo, hi in kernel.slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            n = hi - lo
            starts, ends, owner = kernel.lines_of(part, at)
            word_starts, _, _ = kernel.words_of(part, at)
            words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
            place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
            full = words > 0
            hashes = kernel.SpanHashes(part).of(starts[full], ends[full])
            owner, place, words = owner[full], place[full], words[full]
            bounds = np.searchsorted(owner, np.arange(n + 1))
            found, first, _ = windows_of(hashes, words, bounds[owner], bounds[owner + 1])
            by_text = np.searchsorted(first, bounds)
            total = np.bincount(owner, weights=words, minlength=n).astype(np.int64)
            lists = lambda x, kind, b: pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(total), lists(place, pa.int32(), bounds), lists(hashes.view(np.int64), pa.int64(), bounds), lists(words, pa.int32(), bounds), lists(found.view(np.int64), pa.int64(), by_text)],
                names=["id", "key", "n_words", "place", "h", "words", "windows"],
            )


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal items, ascending in both, by patience diff.

    Ends that agree are matched first; then items that both parts have once, in the longest run ascending in
    both; then what lies between. Where no item is single, the k-th of one part is taken for the k-th of the other.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        single = {x for x, n in in_a.items() if n == 1 and in_b.get(x) == 1}
        if single:
            where = {b[j]: j for j in range(b0, b1) if b[j] in single}
            pairs = [(i, where[a[i]]) for i in range(a0, a1) if a[i] in single]
        else:
            seen: Counter = Counter()
            spots: dict = {}
            for j in range(b0, b1):
                spots[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
            seen.clear()
            pairs = []
            for i in range(a0, a1):
                if (a[i], seen[a[i]]) in spots:
                    pairs.append((i, spots[a[i], seen[a[i]]]))
                seen[a[i]] += 1
        # longest ascending run of the places in b
        tops, top_at, before = [], [], [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            t = bisect_left(tops, j)
            before[k] = top_at[t - 1] if t else -1
            if t == len(tops):
                tops.append(j)
                top_at.append(k)
            else:
                tops[t], top_at[t] = j, k
        k, run = (top_at[-1] if top_at else -1), []
        while k >= 0:
            run.append(pairs[k])
            k = before[k]
        run.reverse()
        out += run
        if single:
            edges = [(a0 - 1, b0 - 1), *run, (a1, b1)]
            todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(edges, edges[1:], strict=False) if i + 1 < x and j + 1 < y]
    return sorted(out)


class Earlier:
    """A text that later ones are aligned with: hashes and word counts of its lines, and where each line stands."""

    def __init__(self, h: np.ndarray, words: np.ndarray):
        self.h = h.tolist()
        self.where: dict[int, list[int]] = {}
        for j, x in enumerate(self.h):
            self.where.setdefault(x, []).append(j)
        self.windows = np.unique(_windows(h, words)[0])

    def blocks(self, h: list[int], words: list[int], left: list[int]) -> list[int]:
        """Of the later text's lines ``left``, those in blocks of the alignment that are long enough."""
        mine = [i for i in left if h[i] in self.where]
        theirs = sorted(j for x in {h[i] for i in mine} for j in self.where[x])
        gone, run, last = [], [], None

        def close() -> None:
            if any(words[i] >= FULL for i in run) or sum(words[i] for i in run) >= LONG:
                gone.extend(run)
            run.clear()

        for a, b in patience([h[i] for i in mine], [self.h[j] for j in theirs]):
            here = (mine[a], theirs[b])
            if last is None or here != (last[0] + 1, last[1] + 1):
                close()
            run.append(here[0])
            last = here
        close()
        return gone

    def common(self, h: np.ndarray, words: np.ndarray) -> list[int]:
        """The lines of a later text that go, ascending."""
        hashes, counts, gone = h.tolist(), words.tolist(), set()
        while found := self.blocks(hashes, counts, [i for i in range(len(hashes)) if i not in gone]):
            gone.update(found)
        window, first, after = _windows(h, words)
        for a, b in zip(first[(shared := np.isin(window, self.windows))].tolist(), after[shared].tolist(), strict=True):
            gone.update(range(a, b))
        return sorted(gone)


def _windows(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return windows_of(h.view(np.uint64), words, np.zeros(len(h), np.int64), np.full(len(h), len(h)))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, id, key, place, h, words) sorted by tile and side: the earlier text first, then the later ones."""
    tile, earlier = None, None
    for batch in batches:
        docs, keys, gone = [], [], []
        lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(k) for k in (4, 5, 6))]
        for k, (name, side, doc, key) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
            place, h, words = (values[at[k] : at[k + 1]] for values, at in lists)
            if name != tile:
                tile, earlier = name, None
            if side == 0:
                earlier = earlier or Earlier(h, words)
            elif found := earlier.common(h, words):
                docs.append(doc)
                keys.append(key)
                gone.append(place[found])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["id", "key", "gone"])


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, gone): the lines, by place from 0, to be deleted from the text with hash ``key`` of row ``id``.

    Rows without a line to delete are not listed. Of two texts the one with the larger id is later. Rows without
    an id, null, empty and blank texts take no part; rows with the same id and text are one document, rows with
    the same id and other texts are ordered by a hash of the text. A text that equals an earlier one loses all its
    lines if it has ``FULL`` words. An empty table gives no rows. Of the tables written on the way only the result stays.
    """
    return store.settled(df.sparkSession, "duplicate-lines", lambda: _duplicate_lines(df, id_col, text_col))


def _duplicate_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id is not null")
    listed = store.written(docs.mapInArrow(kernel.task(_lines), LINES_DDL).filter("n_words > 0"), "lines")
    first = store.written(listed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.max("n_words").alias("n_words")).filter("n > 1"), "copies")
    heavy = skew.heavy_of(first, listed.count())
    same = skew.join(listed.select("id", "key", "place"), first.filter(F.col("n_words") >= FULL).select("key", "least"), ["key"], heavy, ["id"])
    copies = same.filter("id <> least").select("id", "key", F.col("place").alias("gone")).dropDuplicates(["id", "key"])

    held = skew.join(listed.select("id", "key", "windows"), first.select("key", "least"), ["key"], heavy, ["id"], "left").filter("least is null or id = least")
    held = store.written(held.select("id", "key", F.explode(F.array_distinct("windows")).alias("h")), "windows")
    at = F.struct("id", "key")
    shared = held.groupBy("h").agg(F.count("*").alias("n"), F.min(at).alias("owner")).filter("n > 1")
    shared = store.written(shared, "shared-windows")
    pairs = skew.join(held, shared.select("h", "owner"), ["h"], skew.heavy_of(shared, held.count()), ["id", "key"])
    pairs = store.written(pairs.filter(at != F.col("owner")).select("id", "key", F.col("owner.id").alias("id2"), F.col("owner.key").alias("key2")).distinct(), "pairs")
    store.drop(held, shared)

    owners = pairs.groupBy("id2", "key2").agg(F.count("*").alias("n"))
    owners = store.written(owners.withColumn("parts", F.ceil(F.col("n") / ALIGNED)), "owners")
    tile = lambda part: F.concat_ws(":", F.col("id2").cast("string"), F.col("key2").cast("string"), part.cast("string")).alias("tile")
    dealt = skew.join(pairs, owners.drop("n"), ["id2", "key2"], skew.heavy_of(owners, pairs.count()), ["id", "key"])
    rows = dealt.select("id", "key", tile(F.pmod(F.xxhash64("id", "key"), "parts")), F.lit(1).alias("side"))
    rows = rows.union(owners.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.col("id2").alias("id"), F.col("key2").alias("key"), tile(F.col("part")), F.lit(0)))
    rows = listed.select("id", "key", "place", "h", "words").join(rows.hint("merge"), ["id", "key"])
    rows = rows.repartition("tile").sortWithinPartitions("tile", "side").select("tile", "side", "id", "key", "place", "h", "words")
    aligned = rows.mapInArrow(kernel.task(_align), "id long, key long, gone array<int>")
    aligned = aligned.groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return aligned.union(copies)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the duplicate lines deleted from its texts, and two columns more: _n_lines and _n_removed.

    Lines that stay keep their bytes and order; a text that loses all its lines becomes empty. Null texts stay
    null and count no lines; repeated rows are treated alike; columns of any other name stay. Work on one text is
    in proportion to its lines.
    """
    gone = duplicate_lines(df, id_col, text_col).withColumnsRenamed({"id": "__gl_id", "key": "__gl_key", "gone": "__gl_gone"})
    text = F.col(f"`{text_col}`")
    # texts are shuffled at any size: a broadcast of what goes would hold only as long as it is little
    rows = df.withColumn("__gl_key1", F.xxhash64(text)).join(gone.hint("merge"), (F.col(f"`{id_col}`") == F.col("__gl_id")) & (F.col("__gl_key1") == F.col("__gl_key")), "left")
    rows = rows.withColumn("__gl_lines", F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__gl_lines") - 1), "__gl_gone")
    clean = F.array_join(F.transform(left, lambda i: F.col("__gl_lines")[i]), "\n")
    counted = rows.withColumns({"_n_lines": F.coalesce(F.when(text.isNull(), 0).otherwise(F.size("__gl_lines")), F.lit(0)).cast("long"), "_n_removed": F.greatest(F.lit(0), F.coalesce(F.size("__gl_gone"), F.lit(0))).cast("long")})
    return counted.withColumn(text_col, F.when(F.col("__gl_gone").isNotNull(), clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in df.columns], "_n_lines", "_n_removed")
