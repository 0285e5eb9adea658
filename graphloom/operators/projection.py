"""From analysed sources to index documents: text facts, value walks, hierarchies, search and reference documents.

Caps are by source and are reported: what is left out shows as a truncation row and not as a silent loss.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import gather
from graphloom.operators.changes import digest
from graphloom.plans.settle import settled

#: What one source may add to the index.
LIMITS = {
    "text_bytes": 8 * 1024 * 1024, "workspace_objects": 200_000, "unity_values": 2_000_000, "content_term_bytes": 4 * 1024 * 1024, "hierarchy_paths": 100_000, "hierarchy_depth": 128,
    "script_symbols": 4_096, "referenced_script_guids": 65_536, "container_entries": 100_000, "reference_facts": 1_000_000,
}
#: Fields whose text, or whole number, is content.
STRING_FIELDS = ("m_Name", "m_TagString", "m_EditorClassIdentifier", "m_ClassName", "m_Namespace", "m_AssemblyName", "m_Path", "m_PathName", "m_AssetPath", "m_Source", "m_Text", "guid")
NUMBER_FIELDS = ("fileID", "m_FileID", "pathID", "m_PathID")
#: Classes of game objects, transforms and bundles.
GAME_OBJECT, TRANSFORMS, BUNDLE = 1, (4, 224), 142


def valid_prefix(content: Column, most: int) -> Column:
    """The first ``most`` bytes as text, without a character that the cut parts; null if they aren't UTF-8."""
    cuts = [F.substring(content, 1, most - k).cast("string") for k in range(4)]
    fine = [F.when(F.is_valid_utf8(c), c) for c in cuts]
    return F.when(F.octet_length(content) > most, F.coalesce(*fine)).otherwise(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")))


def analyze_text(sources: DataFrame, most: int = LIMITS["text_bytes"], most_symbols: int = LIMITS["script_symbols"], ascii_only: bool = False) -> DataFrame:
    """path, kind, terms, script_symbols, bytes_scanned, truncated, symbols_truncated, incomplete. sources: path, kind, content (binary).

    Content that isn't UTF-8 has no facts and is incomplete; scripts give the names that their lines declare.
    """
    rows = sources.withColumn("_text", valid_prefix(F.col("content"), most))
    lines = F.split(F.regexp_replace("_text", "\r\n", "\n"), "\n")
    declared = F.flatten(F.transform(lines, lambda x: F.filter(F.array(*text.script_symbols(x)), lambda s: s.isNotNull())))
    symbols = F.when(F.col("kind") == "Script", F.array_sort(F.array_distinct(declared))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_symbols", F.when(F.col("_text").isNotNull(), symbols).otherwise(F.array().cast("array<string>")))
    return rows.select(
        "path", "kind", F.coalesce(text.to_terms(F.col("_text"), ascii_only), F.lit("")).alias("terms"), F.slice("_symbols", 1, most_symbols).alias("script_symbols"),
        F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("bytes_scanned"), (F.col("_text").isNotNull() & (F.octet_length("content") > most)).alias("truncated"),
        (F.size("_symbols") > most_symbols).alias("symbols_truncated"), F.col("_text").isNull().alias("incomplete"),
    )


def analysis_metrics(analysed: DataFrame) -> DataFrame:
    """Sums over all sources: how many were texts, their bytes, how many were cut or left out."""
    return analysed.agg(
        F.count("*").alias("sources"), F.count_if(~F.col("incomplete")).alias("text_sources"), F.coalesce(F.sum("bytes_scanned"), F.lit(0)).alias("text_bytes_scanned"),
        F.count_if("truncated").alias("truncations"), F.count_if("incomplete").alias("incomplete"),
    )


# --- values -----------------------------------------------------------------------------------------------------


def container_pair(item: object) -> tuple[str, object] | None:
    """Path and target of a container's entry, which is a list of two or has first and second (or value)."""
    if isinstance(item, list) and len(item) == 2:
        path, target = item
    elif isinstance(item, dict) and "first" in item and ("second" in item or "value" in item):
        path, target = item["first"], item.get("second", item.get("value"))
    else:
        return None
    return (path, target) if isinstance(path, str) else None


def find_reference(value: object) -> tuple[int, int] | None:
    """File and path id of the first reference within a value, depth first."""
    todo = [value]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            file_id, path_id = v.get("fileID", v.get("m_FileID")), v.get("pathID", v.get("m_PathID"))
            if whole(file_id) and whole(path_id):
                return file_id, path_id
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
    return None


def walk_value(class_id: int, fields: dict, most_values: int = LIMITS["unity_values"], most_entries: int = LIMITS["container_entries"]) -> tuple[list[str], list[str], list[tuple[int, str, int, int]], bool]:
    """Content values, script GUIDs and container entries (ordinal, path, file id, path id) of an object; whether it was cut."""
    terms: list[str] = []
    guids: list[str] = []
    entries: list[tuple[int, str, int, int]] = []
    cut, seen = False, 0
    todo: list[tuple[str, object, bool]] = []
    for name, value in reversed(list(fields.items())):
        if class_id == BUNDLE and name == "m_Container":
            items = value if isinstance(value, list) else []
            cut |= len(items) > most_entries
            for k, item in enumerate(items[:most_entries]):
                pair = container_pair(item)
                target = find_reference(pair[1]) if pair else None
                if pair and target:
                    terms.append(pair[0])
                    entries.append((k, pair[0], *target))
        else:
            todo.append((name, value, name == "m_Script"))
    while todo:
        name, value, script = todo.pop()
        seen += 1
        if seen > most_values:
            cut = True
            break
        if isinstance(value, str):
            if name in STRING_FIELDS:
                terms.append(value)
            digits = "".join(c for c in value if c in "0123456789abcdefABCDEF")
            if script and name.lower() == "guid" and len(digits) == 32:
                guids.append(digits.lower())
        elif isinstance(value, int) and not isinstance(value, bool):
            if name in NUMBER_FIELDS:
                terms.append(str(value))
        elif isinstance(value, list):
            todo += [(name, v, script) for v in reversed(value)]
        elif isinstance(value, dict):
            todo += [(k, v, script or k == "m_Script") for k, v in reversed(list(value.items()))]
    return terms, sorted(set(guids)), entries, cut


WALK_DDL = "address string, terms array<string>, script_guids array<string>, entries array<struct<ordinal:int,asset_path:string,file_id:long,path_id:long>>, truncated boolean"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.list_(pa.struct([("ordinal", pa.int32()), ("asset_path", pa.string()), ("file_id", pa.int64()), ("path_id", pa.int64())]))
    for batch in batches:
        found = []
        for class_id, props in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            value = json.loads(props) if props else {}
            found.append(walk_value(class_id or 0, value if isinstance(value, dict) else {}))
        entries = [[dict(zip(("ordinal", "asset_path", "file_id", "path_id"), e, strict=True)) for e in f[2]] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array(entries, entry), pa.array([f[3] for f in found], pa.bool_())], names=["address", "terms", "script_guids", "entries", "truncated"])


def walk_values(objects: DataFrame) -> DataFrame:
    """What an index takes from objects' values, in Arrow batches, as values nest to any depth. objects: address, class_id, props (JSON)."""
    return objects.select("address", F.col("class_id").cast("int").alias("class_id"), "props").mapInArrow(_walk, WALK_DDL)


def container_entries(walked: DataFrame) -> DataFrame:
    """(address, ordinal, asset_path, file_id, path_id) of all container entries; several of one path all stay."""
    return walked.select("address", F.explode("entries").alias("e")).select("address", "e.*")


def container_ordinal(field_path: Column) -> Column:
    """The number of a container's entry in the field path of a reference in it."""
    return F.regexp_extract(field_path, r"^m_Container\[([0-9]+)\]", 1).try_cast("int")


def bind_containers(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """Container entries with their references' outcome, by owner, ordinal and ids; a bag: nothing is made distinct.

    facts: src, field_path, file_id, path_id, state, target.
    """
    f = facts.select(F.col("src").alias("address"), container_ordinal(F.col("field_path")).alias("ordinal"), "file_id", "path_id", "state", "target")
    return entries.join(f.filter("ordinal is not null"), ["address", "ordinal", "file_id", "path_id"])


def hierarchy(facts: DataFrame, classes: DataFrame, names: DataFrame, max_depth: int = LIMITS["hierarchy_depth"]) -> DataFrame:
    """(transform, path, cyclic, truncated): names from the top to the game object of every transform.

    facts: src, field_path, target of resolved references; classes: address, class_id; names: address, name. A chain
    ends where a transform has no named game object; one that meets itself ends there and is cyclic.
    """
    last = F.regexp_extract("field_path", r"([^.\[\]]+)(?:\[[0-9]+\])*$", 1)
    # both ends of a transform in one pass over its facts, so that no task sorts them more than once
    ends_of = facts.select(F.col("src").alias("transform"), last.alias("_last"), "target").filter(F.col("_last").isin("m_GameObject", "m_Father"))
    ends_of = ends_of.groupBy("transform").agg(*[F.max(F.when(F.col("_last") == f, F.col("target"))).alias(c) for f, c in (("m_GameObject", "object"), ("m_Father", "parent"))])
    transforms = classes.filter(F.col("class_id").isin(*TRANSFORMS)).select(F.col("address").alias("transform"))
    own = ends_of.filter("object is not null").join(transforms, "transform", "left_semi")
    nodes = settled(own.join(names.select(F.col("address").alias("object"), "name"), "object").select("transform", "name", "parent"))
    walk = nodes.select("transform", F.col("name").alias("path"), F.col("parent").alias("next"), F.array("transform").alias("seen"))
    up = nodes.select(F.col("transform").alias("next"), F.col("name").alias("_name"), F.col("parent").alias("_parent"))
    done: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        step = walk.join(up, "next", "left")
        met = F.array_contains("seen", F.col("next"))
        over = F.lit(depth >= max_depth) & F.col("next").isNotNull()
        ends = F.col("_name").isNull() | met | over
        done.append(step.filter(ends).select("transform", "path", (F.coalesce(met, F.lit(False))).alias("cyclic"), (over & ~F.coalesce(met, F.lit(False))).alias("truncated")))
        walk = settled(step.filter(~ends).select("transform", F.concat_ws("/", "_name", "path").alias("path"), F.col("_parent").alias("next"), F.concat("seen", F.array("next")).alias("seen")))
        if walk.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# --- documents --------------------------------------------------------------------------------------------------


def guid_key(guid: Column, file_id: Column | None = None) -> Column:
    """guid:<lower-case GUID>, with the id within its file if there is one."""
    plain = F.concat(F.lit("guid:"), F.lower(F.trim(guid)))
    return plain if file_id is None else F.concat_ws(":", plain, file_id.cast("string"))


def object_key(address: str) -> Column:
    return F.concat(F.lit("object:"), digest(address))


def source_key(locator: str) -> Column:
    return F.concat(F.lit("source:"), digest(locator))


#: Fixed value: up to so many rows a source, Spark leaves only those of each task to the one that ranks them (its own threshold).
RANKED_AT_ONCE = 1000


def capped(rows: DataFrame, by: str, order: list[str], most: int, category: str) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each source with their ordinal, and (source, category, emitted, omitted) of those that had more."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    if most <= RANKED_AT_ONCE:
        # dealt evenly, apart from what made the rows; a bare comparison of the rank lets Spark cut each task's rows then
        kept = rows.repartition(by, *order).withColumn("_place", place).filter(F.col("_place") <= most).withColumn("ordinal", F.col("_place") - 1).drop("_place")
    else:
        kept = _numbered_by(rows, by, order, most)
    n = rows.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    cut = n.select(F.col(by).alias("source"), F.lit(category).alias("category"), F.lit(most).cast("long").alias("emitted"), (F.col("n") - most).alias("omitted"))
    return kept, cut


def _numbered_by(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The same for many rows a source: ranges of rows are counted, and each numbers its own from what stands before it."""
    ranged = settled(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_part", (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a source and range
    own = ranged.join(F.broadcast(before.filter(F.col("_before") < most).withColumnRenamed(by, "_by")), (F.col(by).eqNullSafe(F.col("_by"))) & (ranged["_part"] == before["_part"]))
    local = F.row_number().over(Window.partitionBy("_by", ranged["_part"]).orderBy(*order))
    return own.withColumn("ordinal", (F.col("_before") + local - 1).cast("int")).filter(F.col("ordinal") < most).select(*rows.columns, "ordinal")


def script_symbols_by_guid(scripts: DataFrame) -> DataFrame:
    """(guid, symbols): of several sources with one GUID the last by ordinal. scripts: guid, ordinal, symbols."""
    return scripts.filter("guid is not null").groupBy("guid").agg(F.max_by("symbols", "ordinal").alias("symbols"))


def search_documents(assets: DataFrame, scripts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """A search document for each asset; symbols of the scripts that it refers to count as its own.

    assets: stable_id, guid, path, name, kind, content_terms, hierarchy_paths, script_symbols, script_guids.
    """
    rows = gather.by_set(assets, F.col("script_guids"), script_symbols_by_guid(scripts), "guid", F.array_distinct(F.flatten(F.collect_list("symbols"))), "_more")
    symbols = F.array_sort(F.array_distinct(F.concat("script_symbols", F.coalesce("_more", F.array().cast("array<string>")))))
    rows = rows.withColumn("_symbols", symbols)
    terms = lambda c: text.to_terms(c, ascii_only)
    joined = F.concat_ws(" ", F.col("content_terms"), terms(F.array_join("hierarchy_paths", " ")), terms(F.array_join("_symbols", " ")))
    return rows.select(
        "stable_id", "guid", "path", terms(F.col("path")).alias("path_terms"), "name", terms(F.col("name")).alias("name_terms"), "kind", terms(F.col("kind")).alias("kind_terms"),
        F.trim(F.regexp_replace(joined, " +", " ")).alias("content_terms"), "hierarchy_paths", F.col("_symbols").alias("script_symbols"), F.lit(None).cast("string").alias("container_source_path"),
    )


def container_documents(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """A search document for each container entry. entries: source_path, asset_path, file_id, path_id, ordinal."""
    terms = lambda c: text.to_terms(c, ascii_only)
    name, kind, none = text.file_name(F.col("asset_path")), F.lit("BundleContainer"), F.array().cast("array<string>")
    return entries.select(
        F.concat(F.lit("container:"), digest("source_path", "asset_path", "file_id", "path_id", "ordinal")).alias("stable_id"), F.lit(None).cast("string").alias("guid"), F.col("asset_path").alias("path"),
        terms(F.col("asset_path")).alias("path_terms"), name.alias("name"), terms(name).alias("name_terms"), kind.alias("kind"), F.lit("bundle container").alias("kind_terms"),
        F.lit("").alias("content_terms"), none.alias("hierarchy_paths"), none.alias("script_symbols"), F.col("source_path").alias("container_source_path"),
    )


def reference_documents(facts: DataFrame, most: int = LIMITS["reference_facts"]) -> tuple[DataFrame, DataFrame]:
    """Reference documents with the keys by which they are found from both ends, and what the cap left out.

    facts: source_path, source_guid, src, file_id_in_source, field_path, target, target_source, raw_guid, raw_file_id,
    path_id. A raw target with a GUID is found by it; one without by its path id.
    """
    kept, cut = capped(facts, "source_path", ["src", "field_path", "path_id", "raw_guid", "raw_file_id"], most, "references")
    some = lambda *xs: F.array_sort(F.array_distinct(F.filter(F.array(*xs), lambda k: k.isNotNull())))
    known = lambda c, x: F.when(F.col(c).isNotNull(), x)
    incoming = some(
        known("target", object_key("target")), known("target_source", source_key("target_source")), known("raw_guid", guid_key(F.col("raw_guid"))),
        known("raw_guid", known("raw_file_id", guid_key(F.col("raw_guid"), F.col("raw_file_id")))), F.when(F.col("raw_guid").isNull(), known("path_id", F.concat(F.lit("path:"), F.col("path_id").cast("string")))),
    )
    outgoing = some(
        object_key("src"), known("file_id_in_source", F.concat_ws(":", F.lit("file"), digest("source_path"), F.col("file_id_in_source").cast("string"))),
        known("source_guid", guid_key(F.col("source_guid"))), known("source_guid", known("file_id_in_source", guid_key(F.col("source_guid"), F.col("file_id_in_source")))),
    )
    stable = F.concat(F.lit("reference:"), digest("source_path", "src", "field_path", "ordinal"))
    return kept.select(stable.alias("stable_id"), "source_path", "src", "field_path", "ordinal", "target", incoming.alias("incoming_keys"), outgoing.alias("outgoing_keys")), cut


def summary(search_docs: DataFrame, reference_docs: DataFrame, truncations: DataFrame, incomplete: DataFrame) -> DataFrame:
    """One row: documents of either kind, truncations, rows left out and incomplete sources."""
    one = lambda df, *aggs: F.broadcast(df.agg(*aggs))  # noqa: E731  one row each
    n = F.count("*")
    return search_docs.agg(n.alias("search_documents")).join(one(reference_docs, n.alias("reference_documents"))).join(one(truncations, n.alias("truncations"), F.coalesce(F.sum("omitted"), F.lit(0)).alias("omitted"))).join(one(incomplete, n.alias("incomplete")))


def path_catalog(docs: DataFrame, folder: str) -> None:
    """Writes the paths of all documents with their keys, in ranges by the parts of the path, so that a prefix reads few files."""
    parts = F.split("path", "/")
    docs.select("path", "stable_id", "kind").repartitionByRange(parts).sortWithinPartitions(parts, "stable_id").write.parquet(folder)


def portable_order(path: Column) -> Column:
    """What portable paths are compared by: their parts, one by one."""
    return F.split(path, "/")
