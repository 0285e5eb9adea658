"""Changes: guarded plans, previews, change sets, incremental re-indexing, published generations."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*columns: str) -> Column:
    """SHA-256 over length-framed values, so that no two lists of values run together; null and empty differ."""
    framed = [F.when(F.col(c).isNull(), F.lit("n;")).otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit(";"))) for c in columns]
    return F.sha2(F.concat(*framed), 256)


def change_set(before: DataFrame, after: DataFrame, key: str = "address", value: str = "digest") -> DataFrame:
    """(address, change): added, removed or changed between two revisions, by one full join on the key."""
    a, b = before.select(key, F.col(value).alias("_a")), after.select(key, F.col(value).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).filter("change is not null")


def overlay(base: DataFrame, patch: DataFrame, removed: DataFrame | None = None, key: str = "address") -> DataFrame:
    """The base with patched rows in place of its own and removed ones left out: what a reader of the plan sees."""
    hidden = patch.select(key) if removed is None else patch.select(key).union(removed.select(key))
    return base.join(hidden.distinct(), key, "left_anti").unionByName(patch.select(*base.columns))


def guard(base: DataFrame, plan: DataFrame, key: str = "address") -> DataFrame:
    """One row for each planned change: ok, stale (the digest moved), or missing. plan: address, expected."""
    now = base.select(key, F.col("digest").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("expected"), "ok").otherwise("stale")
    return plan.join(now, key, "left").select(key, state.alias("state"))


def prepare(base: DataFrame, plan: DataFrame, key: str = "address") -> DataFrame:
    """The patch of a plan all of whose guards hold; any that doesn't rejects the whole plan. plan: address, expected and new values."""
    if not guard(base, plan, key).filter("state <> 'ok'").isEmpty():
        raise ValueError("a guard doesn't hold")
    return plan


def edit_sequence(items: Column, edit: str, at: int = 0, value: Column | None = None, to: int = 0) -> Column:
    """insert, replace, remove, move or clear in an array, by place from 0."""
    n = F.size(items)
    if edit == "clear":
        return F.slice(items, 1, 0)
    head, tail = F.slice(items, 1, at), F.slice(items, at + 2, F.greatest(n - at - 1, F.lit(0)))
    if edit == "insert":
        return F.concat(head, F.array(value), F.slice(items, at + 1, F.greatest(n - at, F.lit(0))))
    if edit == "replace":
        return F.concat(head, F.array(value), tail)
    rest = F.concat(head, tail)
    if edit == "remove":
        return rest
    if edit == "move":
        return F.concat(F.slice(rest, 1, to), F.array(items[at]), F.slice(rest, to + 1, F.greatest(n - 1 - to, F.lit(0))))
    raise ValueError(edit)


def reindex(index: DataFrame, impacted: DataFrame, fresh: DataFrame, key: str = "src") -> DataFrame:
    """The index with the rows of impacted owners replaced by fresh ones; others are not computed again."""
    return index.join(impacted.select(key).distinct(), key, "left_anti").unionByName(fresh.join(impacted.select(key).distinct(), key, "left_semi").select(*index.columns))


def content_digest(df: DataFrame, *columns: str) -> str:
    """Digest of a table's rows, whatever their order: two sums of 60 bits of each row's digest, and the count."""
    part = lambda at: F.sum(F.conv(F.substring(digest(*columns), at, 15), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count("*"), part(1), part(16)).first()
    return "-".join(str(x or 0) for x in row)


class Generations:
    """Versions of a table in one folder. Every version has a pointer file of its own number, made only if it isn't
    there; readers follow the greatest. So of two writers of one version one fails, and a crash leaves the one before.

    A write may be split: staged rows have a journal entry, from which a later process commits or abandons them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(self.folder)) if (n := s.getPath().getName()).startswith(prefix))

    def _read(self, name: str) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0])
        except (ValueError, TypeError):
            return None  # a writer was cut off within the file

    def _create(self, name: str, body: dict) -> bool:
        """Makes a file that must not be there."""
        try:
            out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or self._fs.exists(self._path(f"{self.folder}/{name}")):
                return False
            raise
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return True

    def current(self) -> dict | None:
        for name in reversed(self._names("CURRENT-")):
            if body := self._read(name):
                return body
        return None

    def read(self) -> DataFrame:
        now = self.current()
        if not now:
            raise FileNotFoundError(self.folder)
        return self.spark.read.parquet(f"{self.folder}/{now['folder']}")

    def stage(self, df: DataFrame, *columns: str) -> dict:
        """Writes the rows of a next version and a journal entry; nothing that readers see."""
        now = self.current()
        version = (now or {"version": 0})["version"] + 1
        folder = f"gen-{version:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{folder}")
        entry = {"version": version, "folder": folder, "digest": content_digest(self.spark.read.parquet(f"{self.folder}/{folder}"), *columns), "base": (now or {}).get("digest")}
        self._create(f"PENDING-{folder}.json", entry)
        return entry

    def commit(self, entry: dict) -> str:
        """Makes a staged version the current one: published, or stale if another came first. Doing it again is harmless."""
        now = self.current()
        if now and now["folder"] == entry["folder"]:
            return "published"
        if (now or {"version": 0})["version"] != entry["version"] - 1:
            return "stale"
        name, version = f"CURRENT-{entry['version']:08d}.json", entry["version"]
        if not self._create(name, {"version": version, "folder": entry["folder"], "digest": entry["digest"]}):
            if self._read(name) is not None:
                return "stale"
            self._fs.delete(self._path(f"{self.folder}/{name}"), False)  # left half written by a crash
            return self.commit(entry)
        return "published"

    def publish(self, df: DataFrame, *columns: str, expected: str | None = None) -> str:
        """Publishes ``df`` as the next version: published, no_change if its digest is the current one, or stale if the current isn't ``expected``."""
        now = self.current()
        if expected is not None and (now or {}).get("digest") != expected:
            return "stale"
        if now and now["digest"] == content_digest(df, *columns):
            return "no_change"
        entry = self.stage(df, *columns)
        outcome = self.commit(entry) if expected is None or entry["base"] == expected else "stale"
        if outcome == "published":
            self.finalize(entry)
        else:
            self.abandon(entry)
        return outcome

    def discover(self) -> list[dict]:
        """Journal entries of staged versions that were neither finalized nor abandoned."""
        return [e for n in self._names("PENDING-") if (e := self._read(n))]

    def finalize(self, entry: dict) -> None:
        """Forgets the journal entry of a committed version."""
        if not any((p := self._read(n)) and p["folder"] == entry["folder"] for n in self._names("CURRENT-")):
            raise ValueError("the version isn't committed")
        self._fs.delete(self._path(f"{self.folder}/PENDING-{entry['folder']}.json"), False)

    def abandon(self, entry: dict) -> None:
        """Removes a staged version and its entry; one that readers see can't be abandoned."""
        if any((p := self._read(n)) and p["folder"] == entry["folder"] for n in self._names("CURRENT-")):
            raise ValueError("the version is committed")
        self._fs.delete(self._path(f"{self.folder}/{entry['folder']}"), True)
        self._fs.delete(self._path(f"{self.folder}/PENDING-{entry['folder']}.json"), False)

    def recover(self) -> list[str]:
        """Finishes or abandons what runs that were cut off left: committed entries are finalized, others abandoned, and
        folders that no entry and no pointer names are removed; returns the folders that went."""
        gone = []
        shown = {p["folder"] for n in self._names("CURRENT-") if (p := self._read(n))}
        for entry in self.discover():
            if entry["folder"] in shown:
                self.finalize(entry)
            else:
                self.abandon(entry)
                gone.append(entry["folder"])
        for name in self._names("gen-"):
            if name not in shown:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
                gone.append(name)
        return sorted(gone)
