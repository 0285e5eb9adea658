"""Extraction: the selection algebra, plans that can be verified, and runs whose results stand in plan order.

A selection is a table of addresses made by one dispatch; a plan is the numbered table with a witness of what was
selected; a run decides what to do with each planned artifact from what is there already, writes the payloads by
task and returns a manifest. What is run again finds its own files, so a run that was cut off is resumed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, selection
from graphloom.operators.changes import digest
from graphloom.plans.settle import settled

#: Classes whose content can be decoded, and the kind and extension of each artifact.
TEXT_ASSET, AUDIO_CLIP, TEXTURE_2D, SPRITE = 49, 83, 28, 213
EXTENSIONS = {"binary_raw": "bin", "yaml": "yaml", "text": "txt", "audio": "audio", "texture_png": "png", "sprite_png": "png"}
#: What may happen to a file that is in the way, and after a failure.
EXISTING = ("error", "skip", "replace")
FAILURES = ("collect_all", "stop_in_plan_order")


@dataclass
class Selection:
    """all, sources, addresses, bundle_container or reference_traversal, with what each of them needs."""

    kind: str = "all"
    sources: Sequence[str] = ()
    addresses: Sequence[str] = ()
    pattern: str = ""
    reverse: bool = False
    max_depth: int | None = None
    max_nodes: int | None = None


@dataclass
class Request:
    selection: Selection = field(default_factory=Selection)
    kinds: Sequence[str] = ()
    class_ids: Sequence[int] = ()
    class_contains: str | None = None
    name_contains: str | None = None
    limit: int | None = None
    prefix: str = ""
    #: raw, decoded_preferred or require_decoded
    representation: str = "raw"


def required(objects: DataFrame, addresses: Sequence[str]) -> DataFrame:
    """Addresses that must all name one object; LookupError names the first that doesn't."""
    wanted = objects.sparkSession.createDataFrame([(a,) for a in sorted(set(addresses))], "address string")
    found = settled(selection.lookup(objects, wanted))
    wrong = found.filter("state <> 'Resolved'").orderBy("address").limit(1).collect()
    if wrong:
        raise LookupError(f"{wrong[0].address}: {wrong[0].state}")
    return found.select("address")


def selected(objects: DataFrame, s: Selection, edges: DataFrame | None = None, entries: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """The addresses of a selection. edges: src, dst; entries: asset_path, state, target of bundle containers.

    Addresses must exist; a traversal that a limit cuts, or containers of an incomplete graph, make an error and not
    a part of the result.
    """
    if s.kind == "all":
        return objects.select("address").distinct()
    if s.kind == "sources":
        return objects.filter(F.col("source").isin(list(s.sources))).select("address").distinct()
    if s.kind == "addresses":
        return required(objects, s.addresses)
    if s.kind == "bundle_container":
        if not complete or entries is None:
            raise ValueError("the reference graph is incomplete")
        own = entries.filter(text.container_match(F.col("asset_path"), s.pattern) & (F.col("state") == "Resolved"))
        return own.select(F.col("target").alias("address")).distinct()
    if s.kind == "reference_traversal":
        if not complete or edges is None:
            raise ValueError("the reference graph is incomplete")
        start = required(objects, s.addresses)
        reached = graph.traverse(edges, start, reverse=s.reverse, max_depth=s.max_depth, max_nodes=s.max_nodes)
        if reached.truncated:
            raise ValueError("the traversal is incomplete")
        return reached.nodes.select("address")
    raise ValueError(s.kind)


def container_occurrences(entries: DataFrame, pattern: str) -> DataFrame:
    """Every entry whose path matches, with its outcome; entries of one path all count."""
    return entries.filter(text.container_match(F.col("asset_path"), pattern))


def representation(class_id: Column, kind: Column, decodable: Column, choice: str) -> Column:
    """The artifact of an object: decoded by its class where that can be done, else YAML or raw; null if it must be decoded and can't."""
    decoded = F.when(class_id == TEXT_ASSET, "text").when(class_id == AUDIO_CLIP, "audio").when(class_id == TEXTURE_2D, "texture_png").when(class_id == SPRITE, "sprite_png")
    plain = F.when(kind == "yaml", "yaml").otherwise("binary_raw")
    if choice == "raw":
        return plain
    return F.when(decodable & decoded.isNotNull(), decoded).otherwise(F.lit(None) if choice == "require_decoded" else plain)


def extension_of(artifact: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(artifact == k, v).otherwise(out)
    return out


def yaml_documents(objects: DataFrame) -> DataFrame:
    """The profile that takes YAML objects only."""
    return objects.filter("kind = 'yaml'")


def plan(objects: DataFrame, request: Request, edges: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """ordinal, address, path, artifact and value_digest of every artifact of a request, in address order."""
    own = selected(objects, request.selection, edges, entries)
    condition = selection.object_filter(request.kinds, request.class_ids, request.class_contains, request.name_contains)
    made = selection.plan(objects, own, condition, request.limit, request.prefix)
    kind, decodable = _or_else(objects, "kind", F.lit("binary")), _or_else(objects, "decodable", F.lit(False))
    more = objects.dropDuplicates(["address"]).select("address", representation(F.col("class_id"), kind, decodable, request.representation).alias("artifact"), digest("class_name", "name").alias("value_digest"))
    joined = made.join(more, "address")
    if request.representation == "require_decoded" and not joined.filter("artifact is null").isEmpty():
        raise ValueError("an object can't be decoded")
    stem = F.regexp_replace("path", r"\.yaml$", "")
    raw = F.when(F.col("artifact") == "binary_raw", ".raw").otherwise("")
    return joined.select("ordinal", "address", F.concat(stem, raw, F.lit("."), extension_of(F.col("artifact"))).alias("path"), "artifact", "value_digest")


def _or_else(df: DataFrame, name: str, other: Column) -> Column:
    return F.col(name) if name in df.columns else other


def witness_of(planned: DataFrame) -> str:
    """Count and digest of the addresses of a plan."""
    row = selection.witness(planned).first()
    return f"{row.selected}:{row.digest}"


def verify(objects: DataFrame, request: Request, planned: DataFrame, witness: str, edges: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(address, problem) of a plan against objects as they are now: changed, gone, unplanned. No rows if the plan still holds."""
    now = plan(objects, request, edges, entries)
    if witness_of(now) == witness and witness_of(planned) == witness:
        both = now.select("address", F.col("value_digest").alias("_now")).join(planned.select("address", "value_digest"), "address")
        return both.filter("_now <> value_digest").select("address", F.lit("changed").alias("problem"))
    a, b = planned.select("address", "path", "value_digest"), now.select("address", F.col("path").alias("_path"), F.col("value_digest").alias("_now"))
    problem = F.when(F.col("_now").isNull(), "gone").when(F.col("value_digest").isNull(), "unplanned").when((F.col("_now") != F.col("value_digest")) | (F.col("path") != F.col("_path")), "changed")
    return a.join(b, "address", "full_outer").select("address", problem.alias("problem")).filter("problem is not null")


def decide(planned: DataFrame, manifest: DataFrame, present: DataFrame, existing: str = "error") -> DataFrame:
    """planned with action: resume, skip, write, replace or fail. manifest and present have path and digest.

    An artifact of the manifest with the same ordinal, address and path is resumed if the bytes that are there have
    its digest; any other file in the way is an error, is left alone or is replaced.
    """
    if existing not in EXISTING:
        raise ValueError(existing)
    old = manifest.select("ordinal", "address", "path", F.col("digest").alias("_old"))
    now = present.select("path", F.col("digest").alias("_there"))
    rows = planned.join(old, ["ordinal", "address", "path"], "left").join(now, "path", "left")
    other = {"error": "fail", "skip": "skip", "replace": "replace"}[existing]
    action = F.when(F.col("_there").isNull(), "write").when(F.col("_old") == F.col("_there"), "resume").otherwise(other)
    return rows.withColumn("action", action).drop("_old", "_there")


def executed(decided: DataFrame, failed: Column, failure: str = "collect_all") -> DataFrame:
    """The manifest: ordinal, address, path, status. With stop_in_plan_order nothing after the first failure counts."""
    if failure not in FAILURES:
        raise ValueError(failure)
    status = F.when((F.col("action") == "fail") | ((F.col("action").isin("write", "replace")) & failed), "Failed").when(F.col("action") == "resume", "Resumed").when(F.col("action") == "skip", "SkippedExisting").otherwise("Written")
    rows = decided.withColumn("status", status)
    if failure == "stop_in_plan_order":
        rows = selection.stop_in_plan_order(rows.withColumn("failed", F.col("status") == "Failed")).drop("failed")
    return rows.select("ordinal", "address", "path", "status")


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        import pyarrow.fs as pafs

        files, place = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        for batch in batches:
            rows = []
            for ordinal, path, action, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                error = None
                if action in ("write", "replace"):
                    try:
                        if payload is None:
                            raise ValueError("no payload")
                        target = f"{place}/{path}"
                        files.create_dir(target.rpartition("/")[0], recursive=True)
                        draft = f"{target}.{uuid.uuid4().hex}.draft"
                        with files.open_output_stream(draft) as out:
                            out.write(payload)
                        if action == "replace" and files.get_file_info(target).type != pafs.FileType.NotFound:
                            files.delete_file(target)
                        files.move(draft, target)  # only a whole file has the name
                    except (OSError, ValueError) as e:
                        error = str(e)
                elif action == "fail":
                    error = "a file is in the way"
                rows.append((ordinal, hashlib.sha256(payload or b"").hexdigest(), error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], names=["ordinal", "digest", "error"])

    return write


def execute(decided: DataFrame, payloads: DataFrame, folder: str, failure: str = "collect_all") -> DataFrame:
    """Writes what is to be written and returns the manifest with digests and errors, in plan order by ordinal.

    payloads: address, payload. Files are written by the tasks that hold their rows and named when they are whole; a
    task that is run again writes the same bytes. With stop_in_plan_order files after the first failure may be there,
    but the manifest doesn't name them.
    """
    rows = decided.join(payloads, "address", "left")
    done = rows.select(F.col("ordinal").cast("long"), "path", "action", "payload").mapInArrow(_write(folder), "ordinal long, digest string, error string")
    done = settled(done)
    joined = decided.withColumn("ordinal", F.col("ordinal").cast("long")).join(done, "ordinal")
    out = executed(joined, F.col("error").isNotNull(), failure)
    return out.join(done, "ordinal").select("ordinal", "address", "path", "status", "digest", "error")


def artifact_by(manifest: DataFrame, **key) -> DataFrame:
    """The artifacts of a manifest with an ordinal, an address or a path."""
    (name, value), *rest = key.items()
    if rest or name not in ("ordinal", "address", "path"):
        raise ValueError("one of ordinal, address, path")
    return manifest.filter(F.col(name) == value)


def canonical_json(df: DataFrame, order: str) -> DataFrame:
    """One line of JSON a row, fields by name, and its digest; what requests, plans and manifests are known by."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    return df.select(F.col(order), line.alias("line"), F.sha2(line, 256).alias("digest"))
