"""Watching a folder: signals, retries, one writer, periodic reconciling, and what became of each operation.

A watched folder is a file-source stream; batches are handled one after the other, so there is one writer. A batch
that fails is tried again after a growing pause and widened to a full scan, as nobody knows how far it came.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Shortest and longest pause between tries, and seconds between two scans of everything.
FIRST_PAUSE_MS, LONGEST_PAUSE_MS, RECONCILE_SECONDS = 250, 30_000, 300
#: States of an operation; those after Running are final.
STATES = ("Queued", "Coalesced", "Running", "Succeeded", "Failed", "Cancelled", "Expired", "Lost")
FINAL = STATES[3:]
#: What may follow each state.
NEXT = {"Queued": ("Coalesced", "Running", "Cancelled", "Expired", "Lost"), "Coalesced": ("Running", "Cancelled", "Expired", "Lost"), "Running": ("Succeeded", "Failed", "Cancelled", "Lost")}
IGNORE_FILE = ".searchignore"


def pause_ms(tries: int) -> int:
    """How long to wait after so many tries that failed: twice as long each time, up to the longest."""
    return min(FIRST_PAUSE_MS << min(max(tries - 1, 0), 20), LONGEST_PAUSE_MS)


def signals(events: DataFrame, by: str, index_folder: str) -> DataFrame:
    """(by, signal, paths) of batches of events (by, path, rescan): Rescan if any asks for it or has no path, Changed with the
    distinct paths otherwise; the index's own folder and nested ignore files are dropped, and a batch of nothing else gives no signal."""
    own = F.col("path").startswith(index_folder.rstrip("/") + "/") | (F.col("path") == index_folder.rstrip("/")) | F.col("path").endswith(f"/{IGNORE_FILE}")
    kept = events.withColumn("_again", F.col("rescan") | F.col("path").isNull()).filter(F.col("_again") | ~own)
    out = kept.groupBy(by).agg(F.max("_again").alias("_again"), F.array_sort(F.collect_set("path")).alias("_paths"))
    return out.select(by, F.when(F.col("_again"), "Rescan").otherwise("Changed").alias("signal"), F.when(F.col("_again"), F.array().cast("array<string>")).otherwise(F.col("_paths")).alias("paths"))


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that appear in a folder: path, modified, length; contents aren't read."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return stream.schema(schema).load(folder).select("path", F.col("modificationTime").alias("modified"), "length")


@dataclass
class Writer:
    """Handles batches of changes in turn. ``apply(scope, rows)`` does the work and may raise."""

    apply: Callable[[str, DataFrame], None]
    most_tries: int = 5
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    log: list[tuple[int, str]] = field(default_factory=list)
    _reconciled: float | None = None

    def handle(self, rows: DataFrame, batch: int) -> None:
        """One batch: changed paths first; after a failure, and when the time for it has come, everything."""
        scope = "changed_paths"
        if self._reconciled is None or self.clock() - self._reconciled >= RECONCILE_SECONDS:
            scope = "reconcile"
        self.log.append((batch, "Running"))
        for tries in range(1, self.most_tries + 1):
            try:
                self.apply(scope, rows)
            except Exception:
                if tries == self.most_tries:
                    self.log.append((batch, "Failed"))
                    raise
                scope = "full"
                self.sleep(pause_ms(tries) / 1000)
                continue
            if scope != "changed_paths":
                self._reconciled = self.clock()
            self.log.append((batch, "Succeeded"))
            return

    def start(self, stream: DataFrame, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
        """Runs until stopped, every ``seconds``; without them, over what is there now."""
        out = stream.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start()


def lifecycle(events: DataFrame) -> DataFrame:
    """(operation, state, changes, valid) from state events (operation, at, state): the last state, how many there were, and
    whether each may follow the one before, from Queued on."""
    over = Window.partitionBy("operation").orderBy("at", "state")
    before = F.lag("state").over(over)
    fine = F.when(before.isNull(), F.col("state") == "Queued")
    for state, later in NEXT.items():
        fine = fine.when(before == state, F.col("state").isin(*later))
    rows = events.withColumn("_fine", F.coalesce(fine.otherwise(F.lit(False)), F.lit(False)))
    return rows.groupBy("operation").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.count("*").alias("changes"), F.min("_fine").alias("valid"))


def expired(operations: DataFrame, now: Column, keep_ms: int) -> DataFrame:
    """Operations (operation, state, at_ms): unfinished ones past their time are Expired, others as they are."""
    late = ~F.col("state").isin(*FINAL) & (now - F.col("at_ms") > keep_ms)
    return operations.withColumn("state", F.when(late, "Expired").otherwise(F.col("state")))


def refresh(index: DataFrame, facts: DataFrame, changed: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index with the facts resolved again that depend on changed keys; what doesn't is taken over.

    index: src, field_path, ... ; facts: src, field_path, key, ...; changed: key.
    """
    touched = facts.join(changed.select("key").distinct(), "key", "left_semi").select("src").distinct()
    fresh = resolve(facts.join(touched, "src", "left_semi"))
    return index.join(touched, "src", "left_anti").unionByName(fresh.select(*index.columns))
