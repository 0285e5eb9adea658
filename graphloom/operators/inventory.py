"""Inventory operators: schema registries, scan plans, member occurrences, candidate merging, streamed resources, recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text


def registry_match(objects: DataFrame, registry: DataFrame) -> DataFrame:
    """The schema of each object by class and version: exact version, else the longest prefix, else any version.

    objects: address, class_id, version. registry: class_id, kind (exact, prefix, any), version, schema, source (0 first).
    The first source with a hit decides; rows of other sources don't mix.
    """
    r = registry.select(F.col("class_id").alias("_class"), "kind", F.col("version").alias("_version"), "schema", F.col("source").alias("_source"))
    fits = (F.col("class_id") == F.col("_class")) & (((F.col("kind") == "exact") & (F.col("version") == F.col("_version"))) | ((F.col("kind") == "prefix") & F.startswith("version", F.col("_version"))) | (F.col("kind") == "any"))
    rank = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "prefix", 1).otherwise(2)
    best = F.min_by("schema", F.struct("_source", rank, -F.length("_version"), "schema"))
    # class ids make this an equi-join; the rest is a filter on the few entries of a class
    return objects.join(r, fits, "left").groupBy("address").agg(F.when(F.count("schema") > 0, best).alias("schema"))


def scan_plan(listing: DataFrame, previous: DataFrame, scope: str, paths: list[str] = ()) -> DataFrame:
    """(path, action): add, update, reuse or remove, from two listings of (path, stamp).

    full reads everything anew; reconcile compares all stamps; changed_paths only touches the named paths and what lies below.
    """
    now, old = listing.select("path", F.col("stamp").alias("_now")), previous.select("path", F.col("stamp").alias("_old"))
    action = F.when(F.col("_now").isNull(), "remove").when(F.col("_old").isNull(), "add")
    action = action.otherwise("update") if scope == "full" else action.when(F.col("_now") != F.col("_old"), "update").otherwise("reuse")
    out = now.join(old, "path", "full_outer")
    if scope == "changed_paths":
        named = F.lit(False)
        for p in paths:
            named |= (F.col("path") == p) | F.startswith("path", F.lit(p.rstrip("/") + "/"))
        # an unnamed path stays as it was known: reused if it was, unseen if it wasn't
        action = F.when(named, action).when(F.col("_old").isNotNull(), "reuse")
    return out.select("path", action.alias("action")).filter("action is not null")


def occurrences(members: DataFrame, owner: str, name: str, order: str) -> DataFrame:
    """Number of each member among those of its name in its container, from 0."""
    return members.withColumn("occurrence", F.row_number().over(Window.partitionBy(owner, name).orderBy(order)) - 1)


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row a key: the best by (score, path, name, kind), with the evidence of all of them.

    candidates: stable_key, score, path, name, kind, evidence (array).
    """
    best = F.min_by(F.struct("score", "path", "name", "kind"), F.struct(-F.col("score"), "path", "name", "kind"))
    merged = candidates.groupBy("stable_key").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return merged.select("stable_key", "b.*", "evidence")


def content_evidence(docs: DataFrame, terms: Column, word: str) -> DataFrame:
    """Rows whose content holds a term: token if as a word (or phrase), substring if as the beginning of one."""
    w = text.terms_of(word)
    framed = F.concat(F.lit(" "), terms, F.lit(" "))
    kind = F.when(F.contains(framed, F.lit(f" {w} ")), "token").when(F.contains(framed, F.lit(f" {w}")), "substring")
    return docs.withColumn("evidence", kind).filter("evidence is not null")


def streamed_resource(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """requests (ref, path, offset, size) with state: Resolved if one source of that path has the range, else Unloaded, Ambiguous or Invalid."""
    s = sources.groupBy(text.external_path(F.col("path")).alias("_path")).agg(F.count("*").alias("_n"), F.max("length").alias("_length"))
    state = F.when(F.col("_n").isNull(), "Unloaded").when(F.col("_n") > 1, "Ambiguous").when((F.col("offset") < 0) | (F.col("size") < 0) | (F.col("offset") + F.col("size") > F.col("_length")), "Invalid").otherwise("Resolved")
    return requests.join(s, text.external_path(requests["path"]) == s["_path"], "left").select("ref", state.alias("state"))


def portable(path: Column) -> Column:
    """Relative, no drive, no empty, dot or dot-dot segment, no backslash or control character."""
    return F.coalesce((path != "") & ~path.rlike(r"^[/\\]|[\x00-\x1f\x7f\\]|^[A-Za-z]:|(^|/)(\.{0,2})(/|$)"), F.lit(False))


def retarget(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """Patch rows for facts whose target moves: (src, field_path, expected, target). moves: old, new."""
    return facts.join(moves, facts["target"] == moves["old"]).select("src", "field_path", F.col("old").alias("expected"), F.col("new").alias("target"))


def move_transform(position: Column, rotation: Column | None = None, **fields: float) -> Column:
    """A transform's struct with some of its fields replaced; the others stay."""
    out = position
    for name, value in fields.items():
        out = out.withField(name, F.lit(value))
    return out if rotation is None else F.struct(out.alias("position"), rotation.alias("rotation"))


def set_texture(textures: Column, slot: str, guid: str) -> Column:
    """A material's array of (slot, guid) with one slot's texture replaced; order and other slots stay."""
    return F.transform(textures, lambda t: F.when(t["slot"] == slot, F.struct(t["slot"].alias("slot"), F.lit(guid).alias("guid"))).otherwise(F.struct(t["slot"].alias("slot"), t["guid"].alias("guid"))))


def mip_bytes(width: Column, height: Column, levels: Column, bytes_per_pixel: int) -> Column:
    """Bytes of a chain of textures, each half the size of the one before, at least one pixel a side."""
    side = lambda v, i: F.greatest(F.floor(v / F.pow(F.lit(2), i)), F.lit(1)).cast("long")
    each = F.transform(F.sequence(F.lit(0), levels - 1), lambda i: side(width, i) * side(height, i) * bytes_per_pixel)
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
