"""Functions over dynamic values and small binary facts: paths, typed look-ups, references, bounds, exact floats, cursors."""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: One part of a field path: a name, or a number in brackets.
PART = re.compile(r"([^.\[\]]+)|\[([0-9]+)\]")


def parse_path(path: str) -> list[str | int]:
    """The parts of a.b[2].c; ValueError for anything else."""
    out: list[str | int] = []
    at = 0
    while at < len(path):
        if path[at] == "." and out:
            at += 1
        m = PART.match(path, at)
        if not m:
            raise ValueError(f"field path {path!r} at {at}")
        out.append(m[1] if m[1] is not None else int(m[2]))
        at = m.end()
    return out


def at_path(value: object, path: str) -> tuple[str, object]:
    """What stands at a path: ok with the value, or ClassRoot, MissingField, ExpectedObject, ExpectedArray, IndexOutOfBounds."""
    parts = parse_path(path)
    if not parts:
        return "ClassRoot", None
    for p in parts:
        if isinstance(p, str):
            if not isinstance(value, dict):
                return "ExpectedObject", None
            if p not in value:
                return "MissingField", None
            value = value[p]
        else:
            if not isinstance(value, list):
                return "ExpectedArray", None
            if p >= len(value):
                return "IndexOutOfBounds", None
            value = value[p]
    return "ok", value


def replaced_at(value: object, path: str, new: object) -> object:
    """A copy of ``value`` with another value at an existing path; KeyError if it isn't there."""
    state, _ = at_path(value, path)
    if state != "ok":
        raise KeyError(state)

    def put(v: object, parts: list[str | int]) -> object:
        if not parts:
            return new
        p, *rest = parts
        if isinstance(v, dict):
            return {k: put(x, rest) if k == p else x for k, x in v.items()}
        return [put(x, rest) if k == p else x for k, x in enumerate(v)]  # type: ignore[arg-type]

    return put(value, parse_path(path))


def semantic_digest(value: object) -> str:
    """SHA-256 of a value's canonical JSON, in which the order of an object's fields doesn't count."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


_FOUND = pa.struct([("state", pa.string()), ("value", pa.string())])


def value_at(props: Column, path: str) -> Column:
    """struct<state, value (JSON)> of what stands at a path of JSON texts, with the kind of error if nothing does."""

    def find(column: pa.Array) -> pa.Array:
        rows = []
        for x in column.to_pylist():
            state, value = at_path(json.loads(x), path) if x is not None else ("MissingField", None)
            rows.append({"state": state, "value": json.dumps(value, sort_keys=True) if state == "ok" else None})
        return pa.array(rows, _FOUND)

    return F.arrow_udf(find, StructType([StructField("state", StringType()), StructField("value", StringType())]))(props)


def semantic_digest_of(props: Column) -> Column:
    """``semantic_digest`` of JSON texts."""
    return F.arrow_udf(lambda c: pa.array([None if x is None else semantic_digest(json.loads(x)) for x in c.to_pylist()], pa.string()), StringType())(props)


def render_path(parts: Column) -> Column:
    """a.b[2].c of array<struct<field, index>>, of which one is null."""
    step = lambda acc, p: F.when(p["field"].isNotNull(), F.concat(acc, F.when(acc == "", "").otherwise("."), p["field"])).otherwise(F.concat(acc, F.lit("["), p["index"].cast("string"), F.lit("]")))
    return F.aggregate(parts, F.lit(""), step)


def reference_state(value: Column) -> Column:
    """NotReference, Valid or Malformed, for values of type variant.

    A mapping with fileID is a reference; its fileID must be a whole number, its guid text, its type a whole number.
    """
    kind = lambda p: F.schema_of_variant(F.try_variant_get(value, p, "variant"))
    there = F.try_variant_get(value, "$.fileID", "variant").isNotNull()
    fine = (kind("$.fileID") == "BIGINT") & F.coalesce(kind("$.guid"), F.lit("STRING")).isin("STRING", "VOID") & F.coalesce(kind("$.type"), F.lit("BIGINT")).isin("BIGINT", "VOID")
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    only = F.size(F.array_except(keys, F.array(F.lit("fileID"), F.lit("guid"), F.lit("type")))) == 0
    return F.when(~there, "NotReference").when(fine & only, "Valid").otherwise("Malformed")


def object_name(value: Column) -> Column:
    """m_Name, else name, of a variant."""
    return F.coalesce(F.try_variant_get(value, "$.m_Name", "string"), F.try_variant_get(value, "$.name", "string"))


def has_property(value: Column, name: str) -> Column:
    """Whether a variant's object has the field, null or not."""
    return F.coalesce(F.array_contains(property_names(value), name), F.lit(False))


def property_names(value: Column) -> Column:
    """The fields of a variant's object, by name."""
    return F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))


def class_names(objects: DataFrame, table: DataFrame) -> DataFrame:
    """objects with class_name from a table (class_id, class_name); a class that isn't listed is Unknown(id). The table is the caller's."""
    named = objects.drop("class_name").join(table.select("class_id", "class_name"), "class_id", "left")
    return named.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("Unknown("), F.col("class_id").cast("string"), F.lit(")"))))


def truncated_utf8(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most ``most`` bytes and no half character."""
    cuts = [F.substring(F.encode(text, "utf-8"), 1, most - k).cast("string") for k in range(min(4, most + 1))]
    fit = F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts], F.lit(""))
    return F.when(F.octet_length(text) <= most, text).otherwise(fit)


def aligned(offset: Column, to: int) -> Column:
    """The next multiple of ``to``."""
    return offset + F.pmod(-offset, F.lit(to))


def class_range(class_id: Column) -> Column:
    """Negative ids are scripts' types, others the engine's."""
    return F.when(class_id < 0, "script").when(class_id == 114, "script").otherwise("engine")


def float_bits(value: Column, single: bool = False) -> Column:
    """The bits of a float as a whole number, so that zeros of either sign and all kinds of NaN are told apart."""

    def bits(c: pa.Array) -> pa.Array:
        x = c.fill_null(0).to_numpy(zero_copy_only=False)
        whole = x.astype(np.float32).view(np.uint32).astype(np.int64) if single else x.astype(np.float64).view(np.int64)
        return pa.array(whole, pa.int64(), mask=c.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(bits, LongType())(value.cast("double"))


def guid_bytes(guid: Column) -> Column:
    """The 16 bytes of a GUID of exactly 32 hex digits, else null."""
    return F.when(guid.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(guid))


def cursor(generation: str, policy: str, query: str, last: str) -> str:
    """What a page's end is continued by: bound to the generation, the policy and the query that it was made for."""
    bound = {"generation": generation, "policy": policy, "query": hashlib.sha256(query.encode()).hexdigest(), "last": last}
    return base64.urlsafe_b64encode(json.dumps(bound, sort_keys=True).encode()).decode()


def continued(token: str, generation: str, policy: str, query: str) -> tuple[str, str | None]:
    """ok with the last id of the page before, StaleCursor for another generation or policy, or InvalidCursor for anything else."""
    try:
        bound = json.loads(base64.urlsafe_b64decode(token.encode()))
        fields = {k: bound[k] for k in ("generation", "policy", "query", "last")}
    except (ValueError, KeyError, TypeError):
        return "InvalidCursor", None
    if not all(isinstance(v, str) for v in fields.values()) or fields["query"] != hashlib.sha256(query.encode()).hexdigest():
        return "InvalidCursor", None
    if (fields["generation"], fields["policy"]) != (generation, policy):
        return "StaleCursor", None
    return "ok", fields["last"]
