"""Selection and extraction: document filters, selectors, ignore rules, plans, artifact paths, resuming."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.plans.settle import settled


def filter_documents(objects: DataFrame, class_names: list[str] = (), attributes: list[str] = (), properties: str = "props") -> DataFrame:
    """Objects of any of the classes that have all attributes; an empty list doesn't restrict. props is a list of names."""
    out = objects
    if class_names:
        out = out.filter(F.col("class_name").isin(list(class_names)))
    for a in attributes:
        out = out.filter(F.array_contains(properties, a))
    return out


def get_one(objects: DataFrame, condition: Column) -> DataFrame:
    """The one object that fulfils the condition; an error if there is none or another one. Two rows are enough to tell."""
    few = objects.filter(condition).limit(2)
    n = F.count("*").over(Window.partitionBy())
    kept = few.withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, F.lit("more than one object fits")).isNull()).drop("_n")
    if few.isEmpty():
        raise LookupError("no object fits")
    return kept


def lookup(objects: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address, state) of exact addresses: Resolved, Missing or Ambiguous."""
    n = objects.join(addresses, "address", "left_semi").groupBy("address").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "Missing").when(F.col("n") == 1, "Resolved").otherwise("Ambiguous")
    return addresses.distinct().join(n, "address", "left").select("address", state.alias("state"))


def object_filter(kinds: list[str] = (), class_ids: list[int] = (), class_contains: str | None = None, name_contains: str | None = None) -> Column:
    """All conditions that are given; a null name never contains anything."""
    out = F.lit(True)
    if kinds:
        out &= F.col("kind").isin(list(kinds))
    if class_ids:
        out &= F.col("class_id").isin(list(class_ids))
    if class_contains:
        out &= F.contains(F.lower("class_name"), F.lit(class_contains.lower()))
    if name_contains:
        out &= F.coalesce(F.contains(F.lower("name"), F.lit(name_contains.lower())), F.lit(False))
    return out


def plan(objects: DataFrame, selected: DataFrame | None, condition: Column, limit: int | None = None, prefix: str = "") -> DataFrame:
    """The artifacts of a selection in address order: ordinal, address, path. The limit counts after the filters.

    The ordinal is a rank over all artifacts; with a limit, only that many rows are sorted together.
    """
    own = objects if selected is None else objects.join(selected.select("address").distinct(), "address", "left_semi")
    own = own.filter(condition).dropDuplicates(["address"])
    if limit is not None:
        own = own.orderBy("address").limit(limit)
        ranked = own.withColumn("ordinal", F.row_number().over(Window.orderBy("address")) - 1)
    else:
        ranked = numbered(own, "address", "ordinal")
    return ranked.select("ordinal", "address", artifact_path(prefix).alias("path"))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with its rank from 0 by ``key``, without sorting all of it in one task: range-partition, count, shift."""
    ranged = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_local") - 1).cast("long")).drop("_part", "_local", "_before")


def artifact_path(prefix: str = "", extension: str = "yaml") -> Column:
    """prefix/sources/source-<slug>/class-<id>-<slug>/<stem>--<digest>.<extension>; SHA-256 stands for the address digest."""
    lead = F.lit(f"{prefix}/" if prefix else "")
    return F.concat(
        lead, F.lit("sources/source-"), text.slug(F.col("source"), 48), F.lit("/class-"), F.col("class_id").cast("string"), F.lit("-"), text.slug(F.col("class_name"), 48),
        F.lit("/"), text.slug(F.coalesce("name", F.lit("object")), 64), F.lit("--"), F.sha2(F.col("address"), 256), F.lit(f".{extension}"),
    )


def witness(planned: DataFrame) -> DataFrame:
    """Count and digest of a selection, independent of how rows lie: per-row digests are summed as numbers of 60 bits and joined."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2("address", 256), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return planned.agg(F.count("*").alias("selected"), F.concat_ws("-", part(1), part(16)).alias("digest"))


def resume(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned artifacts with what to do: an earlier one is resumed if ordinal, address and path agree and its bytes verify."""
    old = manifest.select("ordinal", "address", "path", F.col("digest").alias("old_digest"))
    state = F.when(F.col("old_digest").isNull(), "Written").when(F.col("old_digest") == F.col("digest"), "Resumed").otherwise("Failed")
    return planned.join(old, ["ordinal", "address", "path"], "left").withColumn("status", state).drop("old_digest")


def stop_in_plan_order(results: DataFrame) -> DataFrame:
    """What counts as executed when the first failure in plan order ends a run: everything up to it."""
    first = results.filter("failed").agg(F.min("ordinal").alias("first"))
    return results.join(F.broadcast(first)).filter(F.col("first").isNull() | (F.col("ordinal") <= F.col("first"))).drop("first")


#: one rule of an ignore file
RULE = re.compile(r"^(!)?(exact|subtree|glob):(.+)$")


def parse_rules(lines: list[str]) -> list[tuple[int, str, str, str]]:
    """(ordinal, action, scope, path) of an ignore file's lines; ValueError names the line that is wrong."""
    out = []
    for n, line in enumerate(lines, 1):
        if not line or line.startswith("#"):
            continue
        m = RULE.match(line)
        if not m:
            raise ValueError(f"line {n}: no directive")
        action, scope, path = "include" if m[1] else "exclude", m[2], m[3].replace("\\", "/")
        parts = path.split("/")
        if path[0] == "/" or path[-1] == "/" or path[1:2] == ":" or "" in parts or any(p in (".", "..") for p in parts) or any(ord(c) < 32 or ord(c) == 127 for c in path):
            raise ValueError(f"line {n}: not a relative path")
        if any(set(p) & set("?[]{}") or ("**" in p and p != "**") for p in parts) or any(a == b == "**" for a, b in zip(parts, parts[1:], strict=False)):
            raise ValueError(f"line {n}: unsupported wildcard")
        if ("*" in path) != (scope == "glob"):
            raise ValueError(f"line {n}: wildcards are for glob rules")
        out.append((n, action, scope, path))
    return out


def rule_regex(scope: str, path: str) -> str:
    """Regex of the paths a rule names. In globs, * stays in a segment and ** stands for any number of segments."""
    if scope != "glob":
        return "^" + re.escape(path) + ("(?:/[^/]+)*$" if scope == "subtree" else "$")
    segments = path.split("/")
    out = ""
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            out += "[^/]+(?:/[^/]+)*" if i == 0 and last else "(?:[^/]+/)*" if i == 0 else "(?:/[^/]+)*" if last else "(?:/[^/]+)*/"
        else:
            out += "/" if i and segments[i - 1] != "**" else ""
            out += "[^/]*".join(map(re.escape, s.split("*")))
    return f"^{out}$"


def descend_regex(scope: str, path: str) -> str | None:
    """Regex of the folders in which a later rule may name something."""
    segments = path.split("/")
    fixed = segments[: next((i for i, s in enumerate(segments) if "*" in s), len(segments))]
    chain = fixed if scope == "glob" else segments[:-1]
    if not chain:
        return "^[^/]+(?:/[^/]+)*$" if scope == "glob" else None
    inner = "(?:/[^/]+)*" if scope == "glob" else ""
    for s in reversed(chain[1:]):
        inner = f"(?:/{re.escape(s)}{inner})?"
    return f"^{re.escape(chain[0])}{inner}$"


def decide(path: Column, is_folder: Column, rules: list[tuple[int, str, str, str]]) -> Column:
    """Include, ExcludeButDescend or ExcludeAndPrune: the last rule that names the path decides.

    Rules are few and written by hand, so they are one CASE over the path, tested from the last to the first.
    """
    out = F.lit("Include")
    for k, (_, action, scope, own) in enumerate(rules):
        later = F.lit(False)
        for _, a, s, p in rules[k + 1 :]:
            if a == "include" and (d := descend_regex(s, p)):
                later |= path.rlike(d)
        if action == "include":
            verdict = F.lit("Include")
        else:
            verdict = F.when(is_folder & F.lit(scope == "subtree") & ~later, "ExcludeAndPrune").otherwise("ExcludeButDescend")
        out = F.when(path.rlike(rule_regex(scope, own)), verdict).otherwise(out)
    return out
