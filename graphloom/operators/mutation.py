"""Mutation plans: six kinds of change to objects, guarded, prepared without a write, and taken or refused as a whole.

A plan is a small table of operations. Only the objects that it names are read and edited, each by one task, in the
order of the plan; the result is a patch that an overlay shows before anything is committed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.values import at_path, replaced_at, semantic_digest
from graphloom.operators import changes
from graphloom.plans.settle import settled

#: Kinds of change and of edits to a sequence, the version of plans, bytes of a plan's text.
KINDS = ("field_replace", "reference_replace", "schema_replace", "resource_replace", "sequence_edit", "unsafe_raw_replace")
EDITS = ("insert", "replace", "remove", "move", "clear")
VERSION, MAX_BYTES = 3, 16 * 1024 * 1024
ACKNOWLEDGEMENT = "wire_invariants_are_callers_responsibility_v1"

OPERATIONS_DDL = "ordinal int, kind string, target string, operation string"


@dataclass
class Plan:
    """Operations in order, the revision that they were made for, and payloads by digest."""

    operations: list[dict]
    base_revision: str = ""
    payloads: dict[str, str] = field(default_factory=dict)

    def canonical(self) -> str:
        body = {"version": VERSION, "base_revision": self.base_revision, "operations": [{"ordinal": i, "action": o} for i, o in enumerate(self.operations)], "payloads": self.payloads}
        return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def check(operation: dict) -> None:
    """ValueError for an operation that lacks something or has a sequence edit that does nothing."""
    kind = operation.get("kind")
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r}")
    needed = {
        "field_replace": ("target", "path", "value_digest", "replacement"), "reference_replace": ("target", "path", "expected", "replacement"), "schema_replace": ("target", "value_digest", "replacement"),
        "resource_replace": ("target", "path", "value_digest", "payload"), "sequence_edit": ("target", "path", "value_digest", "edit"), "unsafe_raw_replace": ("target", "expected_raw_digest", "payload", "acknowledgement"),
    }[kind]
    for name in needed:
        if name not in operation:
            raise ValueError(f"{kind} without {name}")
    if kind == "unsafe_raw_replace" and operation["acknowledgement"] != ACKNOWLEDGEMENT:
        raise ValueError("an unsafe change must be acknowledged")
    if kind == "sequence_edit":
        edit = operation["edit"]
        if edit.get("kind") not in EDITS:
            raise ValueError(f"edit {edit.get('kind')!r}")
        if edit["kind"] == "move" and edit.get("from") == edit.get("to"):
            raise ValueError("a move to the same place")


def read_json(text: str | bytes) -> Plan:
    """A plan from strict JSON: bounded, no repeated keys, this version only, ordinals from 0 without gaps."""
    raw = text.encode() if isinstance(text, str) else text
    if len(raw) > MAX_BYTES:
        raise ValueError(f"{len(raw)} bytes in a plan")

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key stands twice")
        return out

    body = json.loads(raw.decode(), object_pairs_hook=once)
    return _from_body(body)


def read_yaml(text: str) -> Plan:
    """The same from one YAML document of plain mappings and lists; anchors, tags and aliases are refused."""
    from graphloom.sources.scenes import value_of

    if len(text.encode()) > MAX_BYTES:
        raise ValueError("too many bytes in a plan")
    lines = text.replace("\r\n", "\n").split("\n")
    if any(line.startswith(("---", "...")) for line in lines[1:]):
        raise ValueError("more than one document")
    return _from_body(value_of([x for x in lines if not x.startswith("---")]))


def _from_body(body: object) -> Plan:
    if not isinstance(body, dict) or set(body) - {"version", "base_revision", "operations", "payloads"}:
        raise ValueError("not a plan")
    if body.get("version") != VERSION:
        raise ValueError(f"version {body.get('version')}")
    entries = body.get("operations") or []
    if [e.get("ordinal") for e in entries] != list(range(len(entries))):
        raise ValueError("ordinals must count from 0")
    operations = [e["action"] for e in entries]
    for o in operations:
        check(o)
    payloads = body.get("payloads") or {}
    for digest, value in payloads.items():
        if hashlib.sha256(value.encode()).hexdigest() != digest:
            raise ValueError("a payload isn't what its digest says")
    return Plan(operations, body.get("base_revision", ""), payloads)


def table(spark: SparkSession, plan: Plan) -> DataFrame:
    """The operations as rows; payloads go with those that name them."""
    rows = []
    for i, o in enumerate(plan.operations):
        check(o)
        own = dict(o)
        if "payload" in own:
            if own["payload"] not in plan.payloads:
                raise ValueError("a payload is missing")
            own["_payload"] = plan.payloads[own["payload"]]
        rows.append((i, o["kind"], o["target"], json.dumps(own)))
    return spark.createDataFrame(rows, OPERATIONS_DDL)


def edited(items: list, edit: dict) -> list:
    """A sequence after one edit; IndexError if it names a place that isn't there."""
    kind, out = edit["kind"], list(items)
    if kind == "clear":
        return []
    at = edit["from"] if kind == "move" else edit["index"]
    if not 0 <= at < len(out) + (kind == "insert"):
        raise IndexError(at)
    if kind == "insert":
        out.insert(at, edit["value"])
    elif kind == "replace":
        out[at] = edit["value"]
    elif kind == "remove":
        del out[at]
    else:
        if not 0 <= edit["to"] < len(out):
            raise IndexError(edit["to"])
        out.insert(edit["to"], out.pop(at))
    return out


def applied(props: str, schema_digest: str | None, operation: dict) -> tuple[str, str]:
    """(state, JSON) after one operation: ok, or what forbids it with the JSON as it was."""
    kind = operation["kind"]
    if kind == "unsafe_raw_replace":
        return ("ok", operation["_payload"]) if hashlib.sha256(props.encode()).hexdigest() == operation["expected_raw_digest"] else ("StaleRaw", props)
    value = json.loads(props)
    if operation.get("schema_digest") not in (None, schema_digest):
        return "SchemaMismatch", props
    if kind == "schema_replace":
        return ("ok", json.dumps(operation["replacement"])) if semantic_digest(value) == operation["value_digest"] else ("StaleValue", props)
    path = operation["path"]
    state, now = at_path(value, path)
    if state != "ok":
        return state, props
    if kind == "reference_replace":
        if now != operation["expected"]:
            return "StaleReference", props
        return "ok", json.dumps(replaced_at(value, path, operation["replacement"]))
    if semantic_digest(now) != operation["value_digest"]:
        return "StaleValue", props
    if kind == "field_replace":
        return "ok", json.dumps(replaced_at(value, path, operation["replacement"]))
    if kind == "resource_replace":
        return "ok", json.dumps(replaced_at(value, path, operation["_payload"]))
    if not isinstance(now, list):
        return "ExpectedArray", props
    try:
        return "ok", json.dumps(replaced_at(value, path, edited(now, operation["edit"])))
    except IndexError:
        return "IndexOutOfBounds", props


APPLIED_DDL = "target string, props string, ordinal int, state string, effect boolean"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for target, props, schema, operations in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            before, now = props, props
            for o in operations:
                if now is None:
                    rows.append((target, None, o["ordinal"], "MissingObject", False))
                    continue
                state, now = applied(now, schema, json.loads(o["operation"]))
                rows.append((target, now, o["ordinal"], state, False))
            if before is not None and rows:
                changed = semantic_digest(json.loads(before)) != semantic_digest(json.loads(now)) if now is not None else False
                rows = [(*r[:4], changed) if r[0] == target else r for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()))], names=["target", "props", "ordinal", "state", "effect"])


def outcomes(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """(target, props, ordinal, state, effect): what every operation would do. objects: address, props (JSON), schema_digest."""
    per = operations.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("ordinal", "operation"))).alias("operations"))  # a plan's few rows
    own = objects.select(F.col("address").alias("target"), "props", "schema_digest")
    return per.join(own, "target", "left").select("target", "props", "schema_digest", "operations").mapInArrow(_apply, APPLIED_DDL)


def prepare(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """The patch (address, props) of a plan all of whose guards hold; ValueError names the first operation that doesn't."""
    found = settled(outcomes(objects, operations))
    wrong = found.filter("state <> 'ok'").orderBy("ordinal").limit(1).collect()
    if wrong:
        raise ValueError(f"operation {wrong[0].ordinal}: {wrong[0].state}")
    last = found.groupBy(F.col("target").alias("address")).agg(F.max_by("props", "ordinal").alias("props"), F.max("effect").alias("effect"))
    return last.filter("effect").select("address", "props")


def preview(objects: DataFrame, patch: DataFrame) -> DataFrame:
    """The objects as a reader of the prepared plan sees them."""
    own = patch.withColumnRenamed("props", "_props")
    return objects.join(own, "address", "left").withColumn("props", F.coalesce("_props", "props")).drop("_props").select(*objects.columns)


def commit(generations: changes.Generations, patch: DataFrame, base_digest: str, *columns: str) -> str:
    """Publishes the objects with the patch if the current version is still the one that the plan was made for."""
    if patch.isEmpty():
        return "no_effect"
    return generations.publish(preview(generations.read(), patch), *columns, expected=base_digest)


# --- recipes: what a change means, as operations -----------------------------------------------------------------


def retarget(target: str, path: str, expected: dict, replacement: dict) -> dict:
    return {"kind": "reference_replace", "target": target, "path": path, "expected": expected, "replacement": replacement}


def _replace(target: str, path: str, now: object, new: object) -> dict:
    return {"kind": "field_replace", "target": target, "path": path, "value_digest": semantic_digest(now), "replacement": new}


def transform(target: str, props: dict, **fields: dict) -> list[dict]:
    """Position, rotation or scale of a transform; only what differs becomes an operation."""
    names = {"position": "m_LocalPosition", "rotation": "m_LocalRotation", "scale": "m_LocalScale"}
    return [_replace(target, names[k], props[names[k]], v) for k, v in fields.items() if props[names[k]] != v]


def material_texture(target: str, props: dict, slot: str, texture: dict) -> dict:
    """The texture of one slot of a material; LookupError if the material has no such slot."""
    slots = at_path(props, "m_SavedProperties.m_TexEnvs")[1] or []
    for k, entry in enumerate(slots):
        if slot in entry:
            path = f"m_SavedProperties.m_TexEnvs[{k}].{slot}.m_Texture"
            return retarget(target, path, entry[slot]["m_Texture"], texture)
    raise LookupError(slot)


CALLS = "m_PersistentCalls.m_Calls"


def event_call(target: str, props: dict, event: str, edit: dict) -> dict:
    """One call of an event added, replaced, removed or moved, or all cleared; its list must be there."""
    path = f"{event}.{CALLS}"
    state, now = at_path(props, path)
    if state != "ok" or not isinstance(now, list):
        raise LookupError(path)
    return {"kind": "sequence_edit", "target": target, "path": path, "value_digest": semantic_digest(now), "edit": edit}


def audio_resource(target: str, props: dict, source: str, offset: int, size: int) -> dict:
    """Another range of streamed bytes for an audio clip."""
    if offset < 0 or size <= 0:
        raise ValueError("an empty or negative range")
    return _replace(target, "m_Resource", props["m_Resource"], {"m_Source": source, "m_Offset": offset, "m_Size": size})


def reindex_state(index_revision: str, change_base: str, change_result: str) -> str:
    """AlreadyApplied if the index is at a change's result, Apply if at its base, else ObserveCurrent: look at all anew."""
    return "AlreadyApplied" if index_revision == change_result else "Apply" if index_revision == change_base else "ObserveCurrent"
