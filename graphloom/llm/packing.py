"""Best-fit packing of token sequences by exact-complement hashing.

The plan depends on nothing but how many pieces there are of each length, so it is made on the driver from
at most ``capacity`` counts. For the longest piece left, its gap is looked up in an index of the single lengths,
the sums of two and the sums of three that are available; a combination that fills the gap exactly is used as
often as the scarcest of its lengths allows. What is left goes into the fullest sequence that still takes it. As exact
combinations of small pieces may take them from larger gaps that only they would fill, this is tried with all
combinations and with fewer kinds of them (``TRIES``), and the plan with the fewest sequences is kept.
Every step empties a length or a group of equal sequences, so the plan has a few entries a length however
large the table is; pieces then find their places by length and number.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import kernel, store
from graphloom.llm.tokens import encoder

CAPACITY = 2048
#: Pieces of one length that are numbered by one task.
RUN = 2_000


class _Sums:
    """The lengths that are left, and for every sum the number of pairs of them that give it.

    A triple sum is a single and a pair sum. The index is kept as lengths run out, so every look-up finds only
    combinations that are there.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.live = counts, counts > 0
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        lengths = np.flatnonzero(self.live)
        for k, x in enumerate(lengths):
            self.pairs[x + lengths[k:]] += 1

    def use(self, lengths: list[int]) -> tuple[int, list[int]]:
        """Takes the combination as often as the scarcest of its lengths allows."""
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(self.counts[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.counts[x] -= times * n
            if times and not self.counts[x]:
                self.pairs[x + np.flatnonzero(self.live)] -= 1
                self.live[x] = False
        return times, lengths

    def pairs_of(self, total: int) -> list[int]:
        """The smaller lengths of all pairs with this sum, the most equal pair first."""
        if total < 2 or not self.pairs[total]:
            return []
        half = np.arange(max(1, total - len(self.live) + 1), total // 2 + 1)
        return half[self.live[half] & self.live[total - half]][::-1].tolist()

    def tops_of(self, total: int) -> list[int]:
        """The largest lengths of triples with this sum, descending."""
        if total < 3:
            return []
        tops = np.flatnonzero(self.live[: total - 1])
        tops = tops[3 * tops >= total]
        return tops[self.pairs[total - tops] > 0][::-1].tolist()


#: What a plan may exactly fill: gaps beside all lengths or those over half a sequence, with so many pieces at most.
TRIES = ((0, 3), (2, 3), (2, 2), (2, 1))


def _exact(counts: np.ndarray, capacity: int, part: int = 0, most: int = 3) -> Iterator[tuple[int, list[int]]]:
    """(times, lengths) of sequences that are exactly full; takes them out of ``counts``.

    With ``part`` only lengths over ``capacity`` / ``part`` are completed, with at most ``most`` other pieces.
    """
    sums = _Sums(counts, capacity)
    for long in range(capacity, capacity // part if part else 0, -1):
        gap = capacity - long
        if counts[long] and not gap:
            yield sums.use([long])
        if counts[long] and gap and counts[gap]:
            if (got := sums.use([long, gap]))[0]:
                yield got
        for a in sums.pairs_of(gap) if counts[long] and most > 1 else []:
            if counts[long] and (got := sums.use([long, gap - a, a]))[0]:
                yield got
        for c in sums.tops_of(gap) if counts[long] and most > 2 else []:
            for a in sums.pairs_of(gap - c) if counts[long] and counts[c] else []:
                if counts[long] and counts[c] and gap - c - a <= c and (got := sums.use([long, c, gap - c - a, a]))[0]:
                    yield got


def _best_fit(counts: np.ndarray, capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]) for the rest, longest first into the smallest gap that takes it."""
    by_gap: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left, gap = int(counts[length]), length
        while left:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:
                full = capacity // length
                if left >= full:
                    by_gap[capacity - full * length].append((left // full, [(length, full)]))
                if left % full:
                    by_gap[capacity - left % full * length].append((1, [(length, left % full)]))
                left = 0
                continue
            times, content = by_gap[gap].pop()
            fit = min(gap // length, max(1, left // times))
            used = min(times, left // fit)
            if used < times:
                by_gap[gap].append((times - used, content))
            by_gap[gap - fit * length].append((used, [*content, (length, fit)]))
            left -= used * fit
            gap = length
    for group in by_gap:
        yield from group


class Plan:
    """Where each piece goes, by its length and its number among those of that length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        have = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            have[length] = n
        groups = min((self._groups(have.copy(), capacity, *t) for t in TRIES), key=lambda made: sum(n for n, _ in made))
        rows, next_rank, sequence = [], defaultdict(int), 0
        for times, content in groups:
            offset = 0
            for length, copies in content:
                rows.append((length, next_rank[length], sequence, copies, offset))
                next_rank[length] += times * copies
                offset += length * copies
            sequence += times
        self.sequences = sequence
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = table[:, 0] << 48 | table[:, 1]
        self.first, self.sequence, self.copies, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    @staticmethod
    def _groups(have: np.ndarray, capacity: int, part: int, most: int) -> list[tuple[int, list[tuple[int, int]]]]:
        groups: list[tuple[int, list[tuple[int, int]]]] = []
        for times, lengths in _exact(have, capacity, part, most):
            runs: dict[int, int] = defaultdict(int)
            for x in lengths:
                runs[x] += 1
            groups.append((times, list(runs.items())))
        return groups + list(_best_fit(have, capacity))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, "right") - 1
        n = rank - self.first[at]
        return self.sequence[at] + n // self.copies[at], self.offset[at] + n % self.copies[at] * length


PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(tokenizer: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        for batch in batches:
            docs, pieces, starts, lengths, sums = [], [], [], [], []
            names = iter(batch.column(0).to_pylist())
            for tokens, bounds in enc.encode_texts(batch.column(1)):
                wide = tokens.astype("<u4")
                for i, doc in zip(range(len(bounds) - 1), names):
                    ids = wide[bounds[i] : bounds[i + 1]].tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        docs.append(doc)
                        pieces.append(k)
                        starts.append(at // 4)
                        lengths.append(len(own) // 4)
                        sums.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text with ``end_id`` appended.

    A null or empty text is one piece with the end id alone; a very long one gives as many pieces as it needs.
    Repeated rows and rows without an id give pieces each; an empty table gives none. Other columns of ``df``,
    whatever their names, aren't returned.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(kernel.task(_cutter(tokenizer, end_id, capacity), "tokens"), PIECES_DDL)


def _placer(plan: Plan, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sequence, offset = plan.place(columns["__gl_length"].to_numpy(), columns["__gl_rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset (from 0, without gaps) in sequences of at most ``capacity``.

    Lengths must lie in 1..capacity, else ValueError. Other columns stay as they are, but ones named
    sequence_id or offset are replaced. Repeated rows get a place each; an empty table gives no rows.
    """
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    rows = store.written(pieces.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{length_col}`").cast("long").alias("__gl_length"), F.xxhash64(*[F.col(f"`{n}`") for n in names]).alias("__gl_hash")), "pieces")
    counts = {r["__gl_length"]: r["count"] for r in rows.groupBy("__gl_length").count().collect()}  # at most one row a length
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    plan = Plan(counts, capacity)
    spark = pieces.sparkSession
    # Numbers within a length: in sub-groups small enough for a task, then shifted by the groups before.
    runs = spark.createDataFrame([(x, -(-n // RUN)) for x, n in counts.items()], "__gl_length long, __gl_runs long")
    dealt = rows.join(F.broadcast(runs), "__gl_length").withColumn("__gl_sub", F.pmod("__gl_hash", "__gl_runs"))
    before = dealt.groupBy("__gl_length", "__gl_sub").agg(F.count("*").alias("__gl_n"))
    before = before.select("__gl_length", "__gl_sub", (F.sum("__gl_n").over(Window.partitionBy("__gl_length").orderBy("__gl_sub")) - F.col("__gl_n")).alias("__gl_before"))
    numbered = dealt.withColumn("__gl_row", F.row_number().over(Window.partitionBy("__gl_length", "__gl_sub").orderBy("__gl_hash"))).join(before, ["__gl_length", "__gl_sub"])
    ranked = numbered.select(*names, "__gl_length", (F.col("__gl_before") + F.col("__gl_row") - 1).alias("__gl_rank"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.mapInArrow(_placer(plan, names), f"{ddl}, sequence_id long, offset long")
