"""Debounced, coalesced change requests, as a bounded query and as a stream.

Events of one owner form a batch until none comes for ``QUIET`` ms, but no batch is open for more than ``LONGEST``
ms after its first event. A batch's scope is the widest of its events' (full, reconcile, changed paths); with
too many paths it becomes full, without any it becomes reconcile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Quiet time, longest time and paths of a batch.
QUIET, LONGEST, MAX_PATHS = 75, 750, 4096
SCOPES = ("changed_paths", "reconcile", "full")


def _fold(quiet: int, longest: int):
    """Reads (owner, ms) sorted by both and gives out a batch when it is closed; what is held is one open batch."""

    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, first, last, n = None, 0, 0, 0
        kind = None
        for rb in rows:
            kind, done = rb.column(0).type, []
            for own, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if n and (own != owner or t >= min(last + quiet, first + longest)):
                    done.append((owner, first, last, n))
                    n = 0
                owner, first, last, n = own, (first if n else t), t, n + 1
            yield _closed(done, kind)
        if n:
            yield _closed([(owner, first, last, n)], kind)

    return fold


def _closed(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["owner", "first", "last", "n"])


def batches(events: DataFrame, owner: str, time_ms: str, quiet: int = QUIET, longest: int = LONGEST) -> DataFrame:
    """(owner, first, last, n) of every batch of a bounded table of events.

    Where a batch ends depends on where it began, so an owner's events are read in order, by one task that holds one
    open batch; events without a time are left out.
    """
    rows = events.filter(F.col(time_ms).isNotNull()).select(F.col(owner).alias("owner"), F.col(time_ms).cast("long").alias("ms"))
    kind = rows.schema["owner"].dataType.simpleString()
    ordered = rows.repartition("owner").sortWithinPartitions("owner", "ms")
    return ordered.mapInArrow(_fold(quiet, longest), f"owner {kind}, first long, last long, n int").withColumnRenamed("owner", owner)


def scope_rank(scope: Column) -> Column:
    return F.when(scope == "full", 2).when(scope == "reconcile", 1).otherwise(0)


def merge_scopes(requests: DataFrame, by: str, max_paths: int = MAX_PATHS) -> DataFrame:
    """(by, scope, paths): requests of a batch as one. Distinct paths are counted before they are listed, and listed only if few."""
    widest = requests.groupBy(by).agg(F.max(scope_rank(F.col("scope"))).alias("_rank"))
    paths = requests.filter("path is not null").select(by, "path").distinct()
    n = paths.groupBy(by).agg(F.count("*").alias("_n"))
    ranked = widest.join(n, by, "left").withColumn("_scope", F.when((F.col("_rank") == 2) | (F.col("_n") > max_paths), "full").when((F.col("_rank") == 1) | F.col("_n").isNull(), "reconcile").otherwise("changed_paths"))
    few = paths.join(ranked.filter("_scope = 'changed_paths'").select(by), by, "left_semi").groupBy(by).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return ranked.join(few, by, "left").select(by, F.col("_scope").alias("scope"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def admit(requests: DataFrame, key: str = "idempotency_key", order: str = "event_id") -> DataFrame:
    """The first request of each idempotency key; requests without a key are all admitted."""
    keyed = requests.filter(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(order).alias(order))
    return keyed.join(first, [key, order], "left_semi").unionByName(requests.filter(F.col(key).isNull()))


#: What a request may come from.
ORIGINS = ("startup", "watcher", "periodic", "recovery", "client")


def origin_counts(requests: DataFrame, by: str) -> DataFrame:
    """Requests of each origin, a column each; what isn't known counts as other."""
    known = [F.count_if(F.col("origin") == o).alias(o) for o in ORIGINS]
    return requests.groupBy(by).agg(*known, F.count_if(~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False))).alias("other"))


STATE = "first long, last long, n long"
OUT = "owner string, first long, last long, n long"


def _debounce(quiet: int, longest: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        first, last, n = state.get if state.exists else (0, 0, 0)
        times = sorted(t for f in frames for t in f["ms"].tolist())
        for t in times:
            if n and t >= min(last + quiet, first + longest):
                done.append((str(key[0]), first, last, n))
                n = 0
            first, last, n = (first if n else t), t, n + 1
        if state.hasTimedOut and n:
            done.append((str(key[0]), first, last, n))
            n = 0
        if n:
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(min(last + quiet, first + longest), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["owner", "first", "last", "n"])

    return step


def debounced(stream: DataFrame, owner: str, time: str, late: str = "1 second", quiet: int = QUIET, longest: int = LONGEST) -> DataFrame:
    """The same batches from a stream, by event time: a batch is given out when the watermark passes its end.

    State is three numbers an owner with an open batch.
    """
    timed = stream.withWatermark(time, late).select(F.col(owner).cast("string").alias("owner"), F.col(time), F.unix_millis(F.col(time)).alias("ms"))
    return timed.groupBy("owner").applyInPandasWithState(_debounce(quiet, longest), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def admitted(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """First request of each key in a stream; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def classify(path: Column, rescan: Column, index_folder: str) -> Column:
    """What a file event means: Rescan, Changed, or null for the index's own files."""
    return F.when(rescan, "Rescan").when(path.isNull(), "Rescan").when(F.startswith(path, F.lit(index_folder)), None).otherwise("Changed")
