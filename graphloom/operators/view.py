"""A workspace as one object: its tables, look-ups over them, and results kept by what they were made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import admission, selection
from graphloom.operators.changes import content_digest

#: Folders that a search for sources doesn't enter.
SKIPPED = (".git", ".svn", ".hg", "node_modules", "target", "Library", "Temp", "Logs", "obj", "bin")


@dataclass
class View:
    """sources: locator, kind, fingerprint, length; objects: address, source, num, class_id, class_name, name; facts: src, ...; contents: locator, content."""

    sources: DataFrame
    objects: DataFrame
    facts: DataFrame | None = None
    contents: DataFrame | None = None

    def revision(self) -> str:
        return admission.revision(self.sources)

    def inventory(self) -> DataFrame:
        return admission.inventory(self.sources, self.objects)

    def source(self, locator: str, known: DataFrame | None = None) -> str:
        """Resolved, Ambiguous, Unloaded, Missing or Invalid."""
        wanted = self.sources.sparkSession.createDataFrame([(locator,)], "locator string")
        return admission.lookup_sources(wanted, self.sources, known if known is not None else self.sources.limit(0)).first().state

    def object(self, address: str) -> DataFrame:
        """The one object with an address; an error if there is none or another one."""
        return selection.get_one(self.objects, F.col("address") == address)

    def source_length(self, locator: str) -> int | None:
        row = self.sources.filter(F.col("locator") == locator).select("length").first()
        return row.length if row else None

    def read_range(self, locator: str, offset: int, length: int) -> tuple[str, bytes | None]:
        """State and bytes of a range of a source's content."""
        if self.contents is None:
            return "Unloaded", None
        row = self.contents.filter(F.col("locator") == locator).select(admission.byte_range(F.col("content"), F.lit(offset), F.lit(length)).alias("r")).first()
        return ("Missing", None) if row is None else (row.r.state, None if row.r.bytes is None else bytes(row.r.bytes))

    def objects_of(self, class_id: int) -> DataFrame:
        return self.objects.filter(F.col("class_id") == class_id)


class Kept:
    """Tables kept in a folder by the digest of what they were made from, so that equal input isn't worked on twice."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def get(self, name: str, key: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The table and whether it was there. A table counts once its success mark is written."""
        place = f"{self.folder}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
        there = self._fs.exists(self._path(f"{place}/_SUCCESS"))
        if not there:
            make().write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place), there

    def by_content(self, name: str, source: DataFrame, columns: Sequence[str], make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
        return self.get(name, content_digest(source, *columns), lambda: make(source))


def enterable(path: Column, skipped: Sequence[str] = SKIPPED) -> Column:
    """Whether no folder of a relative path is one that is skipped; names that begin with a dot are, too."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda x: x.isin(*skipped) | (x.startswith(".") & (F.length(x) > 1)))


def discover(spark: SparkSession, folder: str, pattern: str = "*", skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """(path, modified, length) of the files below a folder, but for skipped folders; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.split("://")[-1].rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z]+:/*", "/"), f"^/*{root.lstrip('/')}/+", "")
    return files.select(relative.alias("path"), F.col("modificationTime").alias("modified"), "length").filter(enterable(F.col("path"), skipped))
