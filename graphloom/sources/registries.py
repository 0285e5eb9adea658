"""Schema registries from files: JSON lists, exported class descriptions, and compiled packages of type trees.

Each reader gives rows (class_id, kind, version, schema, source) for ``registry_match``: kind is exact, prefix or any.
"""

from __future__ import annotations

import json
import lzma
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_DDL = "class_id int, kind string, version string, schema string, source int"


def _kind(version: str) -> tuple[str, str]:
    """5.1.2 is exact, 5.1* a prefix, * or nothing any version."""
    if version in ("", "*"):
        return "any", ""
    return ("prefix", version[:-1]) if version.endswith("*") else ("exact", version)


def from_json(spark: SparkSession, path: str, source: int = 0) -> DataFrame:
    """A file {"schemas": [{"class_id", "version", "nodes"}]}; the schema is the nodes as JSON."""
    text = spark.read.text(path, wholetext=True).first()[0]
    rows = []
    for entry in json.loads(text).get("schemas", []):
        rows.append((int(entry["class_id"]), *_kind(entry.get("version", "")), json.dumps(entry["nodes"], sort_keys=True), source))
    return spark.createDataFrame(rows, ROWS_DDL)


def from_class_export(spark: SparkSession, path: str, source: int = 0) -> DataFrame:
    """An export {"Version", "Classes": [{"TypeID", "Name", "ReleaseRootNode"}]}: exact for its version, read without a loop on the driver."""
    node = "struct<TypeName:string,Name:string,Level:int>"
    schema = f"Version string, Classes array<struct<TypeID:int,Name:string,IsAbstract:boolean,ReleaseRootNode:{node}>>"
    whole = spark.read.text(path, wholetext=True)
    raw = whole.select(F.from_json("value", schema).alias("v"), F.parse_json("value").alias("raw"))
    each = raw.select("v.Version", F.posexplode("v.Classes").alias("at", "c"), "raw").filter("c.ReleaseRootNode is not null")
    tree = F.to_json(F.try_variant_get(F.col("raw"), "$.Classes", "array<variant>")[F.col("at")])
    return each.select(F.col("c.TypeID").alias("class_id"), F.lit("exact").alias("kind"), F.col("Version").alias("version"), F.get_json_object(tree, "$.ReleaseRootNode").alias("schema"), F.lit(source).alias("source"))


#: First bytes of a package, and its ways of compression.
MAGIC, NONE, LZ4, LZMA, BROTLI = b"TPK*", 0, 1, 2, 3


def package(data: bytes) -> bytes:
    """The body of a compiled package: sizes and compression are checked before anything is unpacked."""
    if data[:4] != MAGIC or len(data) < 24:
        raise ValueError("not a package")
    version, method = data[4], data[5]
    packed, raw = struct.unpack_from("<ii", data, 16)
    if version != 1 or packed < 0 or raw < 0 or len(data) < 24 + packed or raw > 1 << 30:
        raise ValueError("a package's header")
    body = data[24 : 24 + packed]
    if method == NONE:
        out = body
    elif method == LZ4:
        out = pa.decompress(body, raw, codec="lz4_raw", asbytes=True)
    elif method == LZMA:
        out = lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(body[:5] + struct.pack("<q", raw) + body[5:], raw)
    elif method == BROTLI:
        out = pa.decompress(body, raw, codec="brotli", asbytes=True)
    else:
        raise ValueError(f"compression {method}")
    if len(out) != raw:
        raise ValueError(f"{len(out)} bytes for {raw}")
    return out


def tree_stats(nodes: DataFrame) -> DataFrame:
    """(schema, nodes, depth, kinds) of type trees given as rows (schema, level, kind)."""
    return nodes.groupBy("schema").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"), F.countDistinct("kind").alias("kinds"))


def merged_stats(stats: DataFrame) -> DataFrame:
    """The sum of several runs' counters; a sum beyond the range of whole numbers is an error and not a wrap."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    checked = lambda c: F.when(total(c) > 9223372036854775807, F.raise_error(F.lit(f"{c} overflows"))).otherwise(total(c).cast("long"))
    return stats.agg(checked("nodes").alias("nodes"), F.max("depth").alias("depth"))
