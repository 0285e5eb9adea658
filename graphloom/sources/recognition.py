"""What kind of source a file is, from its first bytes and its extension, in that order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import text

#: Magic prefixes, the serialized formats that exist, extensions.
ZIP = ("504B0304", "504B0506", "504B0708")
WEB_FILE = (b"UnityWebData", b"TuanjieWebData")
BUNDLE = (b"UnityFS\0", b"UnityRaw", b"UnityWeb")
YAML_EXTENSIONS = ("unity", "prefab", "asset", "mat", "anim", "controller", "meta", "yaml", "yml")
RESOURCE_EXTENSIONS = ("ress", "resource")


def _starts(data: Column, prefix: bytes) -> Column:
    return F.startswith(data, F.lit(prefix))


def _uint32(data: Column, at: int) -> Column:
    """Big-endian number at byte ``at``."""
    return F.conv(F.hex(F.substring(data, at + 1, 4)), 16, 10).cast("long")


def looks_serialized(data: Column) -> Column:
    """A serialized file's header: a format that exists, and a declared size that holds metadata and data."""
    version = _uint32(data, 8)
    exists = version.isin(2, 3) | ((version >= 5) & (version <= 22))
    wide = version >= 22
    metadata = F.when(wide, _uint32(data, 20)).otherwise(_uint32(data, 0))
    size = F.when(wide, F.conv(F.hex(F.substring(data, 25, 8)), 16, 10).cast("decimal(20,0)")).otherwise(_uint32(data, 4).cast("decimal(20,0)"))
    offset = F.when(wide, F.conv(F.hex(F.substring(data, 33, 8)), 16, 10).cast("decimal(20,0)")).otherwise(_uint32(data, 12).cast("decimal(20,0)"))
    header = F.when(wide, 48).when(version >= 9, 20).otherwise(16)
    fits = F.when(version >= 9, (metadata + header <= size) & (offset <= size) & (offset >= header)).otherwise((metadata <= size) & (offset <= size))
    return F.coalesce((F.octet_length(data) >= F.when(wide, 48).otherwise(20)) & exists & fits, F.lit(False))


def recognize(path: Column, data: Column) -> Column:
    """Archive, Yaml, WebFile, AssetBundle, SerializedFile, YamlOrBinary, StreamedResource or Unknown; content comes before the extension."""
    ext = text.extension(F.coalesce(path, F.lit("")))
    zipped = F.hex(F.substring(data, 1, 4)).isin(*ZIP)
    yaml = _starts(data, b"%YAML") | _starts(data, b"--- !u!") | _starts(data, b"\xef\xbb\xbf%YAML")
    web = _starts(data, WEB_FILE[0]) | _starts(data, WEB_FILE[1])
    bundle = (F.octet_length(data) >= 8) & (_starts(data, BUNDLE[0]) | _starts(data, BUNDLE[1]) | _starts(data, BUNDLE[2]))
    return (
        F.when(zipped, "Archive")
        .when(yaml, "Yaml")
        .when(web, "WebFile")
        .when(bundle, "AssetBundle")
        .when(looks_serialized(data), "SerializedFile")
        .when(ext.isin("zip", "apk"), "Archive")
        .when(ext.isin(*YAML_EXTENSIONS), "YamlOrBinary")
        .when(ext.isin(*RESOURCE_EXTENSIONS), "StreamedResource")
        .otherwise("Unknown")
    )
