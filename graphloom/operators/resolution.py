"""Resolution of references to six outcomes: Null, Resolved, Unloaded, Missing, Ambiguous, Invalid.

The order of the tests is the contract: a null target is Null before anything else is looked at; a source that
isn't there makes Unloaded, several make Ambiguous, and a source without the object makes Missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text

STATES = ("Null", "Resolved", "Unloaded", "Missing", "Ambiguous", "Invalid")


def candidates(facts: DataFrame, externals: DataFrame) -> DataFrame:
    """Facts with the sources that their file index may mean: their own for 0, those of the external table otherwise.

    listed is whether the index is in the table at all. The table is small and static; Spark broadcasts it by size.
    """
    table = externals.groupBy("source", "file_id").agg(F.sort_array(F.collect_set("candidate")).alias("listed_candidates"))
    joined = facts.join(table, ["source", "file_id"], "left")
    own = F.when(F.col("file_id") == 0, F.array("source")).otherwise(F.coalesce("listed_candidates", F.array().cast("array<string>")))
    return joined.select(*[F.col(c) for c in facts.columns], own.alias("candidates"), ((F.col("file_id") == 0) | F.col("listed_candidates").isNotNull()).alias("listed"))


def resolve(facts: DataFrame, externals: DataFrame, objects: DataFrame) -> DataFrame:
    """facts with candidates, state and target. One shuffle on the target key; facts without a single source skip it."""
    known = candidates(facts, externals)
    one = F.when((F.col("path_id") != 0) & (F.col("file_id") >= 0) & (F.size("candidates") == 1), F.element_at("candidates", 1))
    keyed = known.withColumn("_source", one)
    target = objects.select(F.col("source").alias("_source"), (F.col("num") + 1).alias("path_id"), F.col("address").alias("target"))
    hit = keyed.join(target, ["_source", "path_id"], "left")
    state = (
        F.when(F.col("path_id") == 0, "Null")
        .when(F.col("file_id") < 0, "Invalid")
        .when(~F.col("listed"), "Invalid")
        .when(F.size("candidates") == 0, "Unloaded")
        .when(F.size("candidates") > 1, "Ambiguous")
        .when(F.col("target").isNotNull(), "Resolved")
        .otherwise("Missing")
    )
    return hit.select(*[F.col(c) for c in facts.columns], "candidates", state.alias("state"), F.when(F.size("candidates") == 1, F.col("target")).alias("target"))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """One row: how many facts have each outcome, in one pass."""
    return resolved.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])


def yaml_state(file_id: Column, guid: Column, local_hit: Column, sources: Column, hit: Column) -> Column:
    """State of a reference by (file id, GUID): no file id Invalid, 0 Null, no GUID local, bad or zero GUID Invalid, else by GUID."""
    good = text.guid(guid)
    return (
        F.when(file_id.isNull(), "Invalid")
        .when(file_id == 0, "Null")
        .when(guid.isNull(), F.when(local_hit, "Resolved").otherwise("Missing"))
        .when(good.isNull() | (F.length(guid) != 32) | (good == "0" * 32), "Invalid")
        .when(sources == 0, "Unloaded")
        .when(sources > 1, "Ambiguous")
        .when(hit, "Resolved")
        .otherwise("Missing")
    )


def path_sources(references: DataFrame, claims: DataFrame) -> DataFrame:
    """(ref, sources): sources claiming a reference's normalised path, else its base name; of several, those beside the referrer if any.

    references: ref, path, parent. claims: source, path, parent.
    """
    refs = references.select("ref", text.external_path(F.col("path")).alias("path"), "parent")
    own = claims.select("source", text.external_path(F.col("path")).alias("claim"), F.col("parent").alias("claim_parent"))
    exact = refs.join(own, refs["path"] == own["claim"]).select("ref", "parent", "source", "claim_parent")
    by_name = refs.join(exact.select("ref").distinct(), "ref", "left_anti").withColumn("base", text.file_name(F.col("path")))
    named = own.withColumn("base", text.file_name(F.col("claim")))
    loose = by_name.join(named, "base").select("ref", "parent", "source", "claim_parent")
    hits = exact.unionByName(loose)
    near = F.max((F.col("parent") == F.col("claim_parent")).cast("int")).over(Window.partitionBy("ref"))
    many = F.count("*").over(Window.partitionBy("ref"))
    kept = hits.withColumns({"_near": near, "_many": many}).filter((F.col("_many") == 1) | (F.coalesce("_near", F.lit(0)) == 0) | (F.col("parent") == F.col("claim_parent")))
    return kept.groupBy("ref").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def reconcile(by_guid: Column, by_path: Column, conflicting: Column, has_guid: Column) -> Column:
    """struct<state, sources> of two kinds of evidence: their intersection if both have some, which must not be empty;
    paths less those that claim another GUID if the GUID is unknown."""
    both = F.array_sort(F.array_intersect(by_guid, by_path))
    left = F.array_sort(F.when(has_guid, F.array_except(by_path, conflicting)).otherwise(by_path))
    return (
        F.when((F.size(by_guid) > 0) & (F.size(by_path) > 0), F.struct(F.when(F.size(both) > 0, "Candidates").otherwise("Invalid").alias("state"), both.alias("sources")))
        .when(F.size(by_guid) > 0, F.struct(F.lit("Candidates").alias("state"), F.array_sort(by_guid).alias("sources")))
        .when((F.size(by_path) > 0) & (F.size(left) == 0), F.struct(F.lit("Invalid").alias("state"), left.alias("sources")))
        .otherwise(F.struct(F.lit("Candidates").alias("state"), left.alias("sources")))
    )


def dependency_keys(resolved: DataFrame) -> DataFrame:
    """(src, field_path, direction, key): the keys by which a fact is looked up, one row each.

    Incoming keys name the target and its source, outgoing ones the fact's own object and source.
    """
    incoming = F.array_distinct(F.filter(F.array(F.concat(F.lit("object:"), F.col("target")), F.concat(F.lit("source:"), F.substring_index("target", ":", 1))), lambda k: k.isNotNull()))
    outgoing = F.array(F.concat(F.lit("object:"), F.col("src")), F.concat(F.lit("source:"), F.col("source")))
    keys = F.concat(F.transform(incoming, lambda k: F.struct(F.lit("in").alias("direction"), k.alias("key"))), F.transform(outgoing, lambda k: F.struct(F.lit("out").alias("direction"), k.alias("key"))))
    return resolved.select("src", "field_path", F.explode(keys).alias("k")).select("src", "field_path", "k.direction", "k.key")


def impact(resolved: DataFrame, changed_objects: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """Sources of facts that a change touches: a union of semi joins, each on one key, never one join with OR."""
    by_target = resolved.join(changed_objects.select(F.col("address").alias("target")), "target", "left_semi")
    by_owner = resolved.join(changed_objects.select(F.col("address").alias("src")), "src", "left_semi")
    by_source = resolved.join(changed_sources.select("source"), "source", "left_semi")
    listed = resolved.select("*", F.explode("candidates").alias("_c")).join(changed_sources.select(F.col("source").alias("_c")), "_c", "left_semi").drop("_c")
    parts = [x.select("src", "field_path") for x in (by_target, by_owner, by_source, listed)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def reference_page(keys: DataFrame, key: str, direction: str, after: str, limit: int) -> DataFrame:
    """One page of a key's facts by keyset: rows after the cursor, ``limit`` of them, with whether more follow and how many there are."""
    own = keys.filter((F.col("key") == key) & (F.col("direction") == direction)).select("src", "field_path").distinct()
    ids = own.select(F.concat_ws("#", "src", "field_path").alias("stable_id"))
    total = ids.agg(F.count("*").alias("total"))
    page = ids.filter(F.col("stable_id") > after).orderBy("stable_id").limit(limit + 1)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy("stable_id")))  # limit + 1 rows at most
    more = F.max("rank").over(Window.partitionBy()) > limit
    return ranked.select("stable_id", "rank", more.alias("truncated")).filter(F.col("rank") <= limit).join(F.broadcast(total))
