"""Sources of a workspace: admission in batches that take effect as a whole or not at all, inventory and reads.

A workspace revision is a table of sources; a batch makes the next one from it by one anti join and one union.
Nothing is changed in place, so a batch with an error leaves the revision as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import gather
from graphloom.operators.changes import digest
from graphloom.plans.settle import settled

POLICIES = ("strict", "lenient")
SOURCES_DDL = "locator string, kind string, fingerprint string, length long"


def plan_batch(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """Each operation with its outcome: Loaded, Replaced, Unchanged, Unloaded, or an error. batch: ordinal, op, locator, kind, fingerprint, length.

    Operations are load (nothing may be there), replace (something must), and unload (something must). Of several on
    one source only the first counts; the others are errors.
    """
    first = F.row_number().over(Window.partitionBy("locator").orderBy("ordinal"))
    there = sources.select("locator", F.col("fingerprint").alias("_there"))
    rows = batch.withColumn("_nth", first).join(there, "locator", "left")
    outcome = (
        F.when(F.col("locator").isNull() | ~F.col("op").isin("load", "replace", "unload"), "InvalidOperation")
        .when(F.col("_nth") > 1, "DuplicateOperation")
        .when(F.col("op") == "load", F.when(F.col("_there").isNotNull(), "AlreadyLoaded").when(F.col("fingerprint").isNull(), "Unreadable").otherwise("Loaded"))
        .when(F.col("_there").isNull(), "NotLoaded")
        .when(F.col("op") == "unload", "Unloaded")
        .when(F.col("fingerprint").isNull(), "Unreadable")
        .when(F.col("fingerprint") == F.col("_there"), "Unchanged")
        .otherwise("Replaced")
    )
    return rows.withColumn("outcome", outcome).drop("_nth", "_there")


DONE = ("Loaded", "Replaced", "Unchanged", "Unloaded")


def admit(sources: DataFrame, batch: DataFrame, policy: str = "strict") -> tuple[DataFrame, DataFrame]:
    """The sources after a batch, and its report (ordinal, op, locator, outcome).

    strict: any error leaves all sources as they are; lenient: operations without an error take effect.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    planned = settled(plan_batch(sources, batch))
    report = planned.select("ordinal", "op", "locator", "outcome")
    if policy == "strict" and not planned.filter(~F.col("outcome").isin(*DONE)).isEmpty():
        return sources, report
    gone = planned.filter(F.col("outcome").isin("Replaced", "Unloaded")).select("locator")
    fresh = planned.filter(F.col("outcome").isin("Loaded", "Replaced")).select(*sources.columns)
    return sources.join(gone, "locator", "left_anti").unionByName(fresh), report


def load(sources: DataFrame, locator: str, kind: str, fingerprint: str, length: int) -> DataFrame:
    """The sources with one more; ValueError if it is there already."""
    one = sources.sparkSession.createDataFrame([(0, "load", locator, kind, fingerprint, length)], f"ordinal int, op string, {SOURCES_DDL}")
    return _one(*admit(sources, one))


def unload(sources: DataFrame, locator: str) -> DataFrame:
    """The sources without one; ValueError if it isn't there."""
    one = sources.sparkSession.createDataFrame([(0, "unload", locator, None, None, None)], f"ordinal int, op string, {SOURCES_DDL}")
    return _one(*admit(sources, one))


def _one(after: DataFrame, report: DataFrame) -> DataFrame:
    outcome = report.first().outcome
    if outcome not in DONE:
        raise ValueError(outcome)
    return after


def admission_counts(report: DataFrame) -> DataFrame:
    """How many operations had each outcome, in one row."""
    names = (*DONE, "AlreadyLoaded", "NotLoaded", "Unreadable", "DuplicateOperation", "InvalidOperation")
    return report.agg(*[F.count_if(F.col("outcome") == n).alias(_snake(n)) for n in names])


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


def revision(sources: DataFrame) -> str:
    """A digest of what is loaded, whatever the order."""
    from graphloom.operators.changes import content_digest

    return content_digest(sources, "locator", "kind", "fingerprint")


def inventory(sources: DataFrame, objects: DataFrame) -> DataFrame:
    """locator, kind, length, objects, classes, least and greatest path id of every source, those without objects too."""
    n = objects.groupBy(F.col("source").alias("locator")).agg(F.count("*").alias("objects"), F.countDistinct("class_id").alias("classes"), F.min("num").alias("least"), F.max("num").alias("greatest"))
    return sources.join(n, "locator", "left").select("locator", "kind", "length", F.coalesce("objects", F.lit(0).cast("long")).alias("objects"), F.coalesce("classes", F.lit(0).cast("long")).alias("classes"), "least", "greatest")


def lookup_sources(wanted: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """(locator, state): Resolved, Ambiguous, Unloaded (known but not loaded), Missing or Invalid (no portable path)."""
    from graphloom.operators.inventory import portable

    n = sources.groupBy("locator").agg(F.count("*").alias("_n"))
    seen = known.select("locator").distinct().withColumn("_known", F.lit(True))
    state = F.when(~portable(F.col("locator")), "Invalid").when(F.col("_n") == 1, "Resolved").when(F.col("_n") > 1, "Ambiguous").when(F.col("_known"), "Unloaded").otherwise("Missing")
    return wanted.select("locator").distinct().join(n, "locator", "left").join(seen, "locator", "left").select("locator", state.alias("state"))


def object_inventory(objects: DataFrame) -> DataFrame:
    """What there is to know of every object without reading it."""
    return objects.select("address", "source", F.col("num").alias("path_id"), "class_id", "class_name", "name", digest("source", "num", "class_id").alias("identity"))


def byte_range(content: Column, offset: Column, length: Column) -> Column:
    """struct<state, bytes> of a range of a source: InvalidRange beyond its ends or for negative numbers."""
    fits = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(content))
    cut = F.substring(content, (offset + 1).cast("int"), length.cast("int"))
    return F.when(content.isNull(), F.struct(F.lit("Unloaded").alias("state"), F.lit(None).cast("binary").alias("bytes"))).otherwise(F.struct(F.when(fits, "Resolved").otherwise("InvalidRange").alias("state"), F.when(fits, cut).alias("bytes")))


def stable_read(listed: DataFrame, read: DataFrame, listed_again: DataFrame) -> DataFrame:
    """(path, state, digest) of a read between two listings of (path, stamp, length): stable only if nothing moved meanwhile.

    read: path, content. A source that changed, grew or went is to be read again.
    """
    before = listed.select("path", F.col("stamp").alias("_s1"), F.col("length").alias("_n1"))
    after = listed_again.select("path", F.col("stamp").alias("_s2"), F.col("length").alias("_n2"))
    rows = before.join(read.select("path", "content"), "path", "left").join(after, "path", "left")
    state = F.when(F.col("_s2").isNull(), "Gone").when((F.col("_s1") != F.col("_s2")) | (F.col("_n1") != F.col("_n2")), "Changed").when(F.col("content").isNull(), "Unreadable").when(F.octet_length("content") != F.col("_n2"), "Torn").otherwise("Stable")
    return rows.select("path", state.alias("state"), F.when(state == "Stable", F.sha2(F.col("content"), 256)).alias("digest"))


def claims(sources: DataFrame, metas: DataFrame) -> DataFrame:
    """(source, guid): the GUID that a source's .meta file claims for it. metas: path, guid."""
    from graphloom.functions import text

    own = metas.filter(F.lower("path").endswith(".meta")).select(F.expr("left(path, length(path) - 5)").alias("locator"), text.guid(F.col("guid")).alias("guid")).filter("guid is not null")
    return sources.select("locator").join(own, "locator").select(F.col("locator").alias("source"), "guid").distinct()


def guid_sources(references: DataFrame, claimed: DataFrame) -> DataFrame:
    """(ref, sources): all sources that claim a reference's GUID, sorted. references: ref, guid."""
    refs = references.repartition("ref").groupBy("ref").agg(F.collect_set("guid").alias("_guids"))  # dealt first: a task that reads may read all
    found = gather.by_set(refs, F.col("_guids"), claimed, "guid", F.array_sort(F.collect_set("source")), "sources")
    return found.select("ref", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def script_symbols(objects: DataFrame, symbols: DataFrame) -> DataFrame:
    """(address, symbols) of the scripts that an object refers to. objects: address, guids; symbols: guid, symbol."""
    return gather.by_set(objects, F.col("guids"), symbols, "guid", F.array_sort(F.collect_set("symbol")), "symbols").filter("symbols is not null").select("address", "symbols")
