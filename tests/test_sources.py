"""Scene documents and binary containers, made here byte by byte."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.sources import containers, recognition, scenes

SCENE = """%YAML 1.1
%TAG !u! tag:example,2011:
--- !u!1 &100
GameObject:
  m_Component:
  - component: {fileID: 200}
  - component: {fileID: 999}
  m_Name: 'It''s'
  m_Icon: {fileID: 0}
  m_Bad: {fileID: 5, extra: 1}
  m_Script: {fileID: 11500000, guid: 0123456789abcdef0123456789abcdef,
    type: 3}
  long: one
    two
  ratios:
    4:3: 1
--- !u!4 &-200 stripped
Transform:
  m_GameObject: {fileID: 100}
  m_LocalPosition: {x: 0, y: -1.5, z: 1e3}
  m_Children: []
  ids: [1, "2", [3, ~]]
--- !u!114 &300
MonoBehaviour:
  a: 1
  a: 2
"""


def test_scene_documents():
    a, b, c = scenes.documents(SCENE)
    assert (a["class_id"], a["class_name"], a["file_id"], b["file_id"], b["anchor"]) == (1, "GameObject", 100, -200, "stripped")
    assert a["props"]["m_Name"] == "It's" and a["props"]["long"] == "one two" and a["props"]["ratios"] == {"4:3": 1}
    assert b["props"]["m_LocalPosition"] == {"x": 0, "y": -1.5, "z": 1000.0} and b["props"]["ids"] == [1, "2", [3, None]]
    assert c["props"] is None and "twice" in c["error"]
    assert list(scenes.references(a["props"])) == [
        ("m_Component[0].component", 200, None, None, "Valid"),
        ("m_Component[1].component", 999, None, None, "Valid"),
        ("m_Icon", 0, None, None, "Null"),
        ("m_Bad", 5, None, None, "Malformed"),
        ("m_Script", 11500000, "0123456789abcdef0123456789abcdef", 3, "Valid"),
    ]


@pytest.mark.parametrize(("text", "value"), [("007", "007"), ("0", 0), ("-5", -5), ("0x1F", 31), ("0o17", 15), ("1.0.0", "1.0.0"), ("1.", 1.0), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", "18446744073709551616"), ("~", None), ("TRUE", True), ("tRue", "tRue"), (".5e3", 500.0), ("-.inf", float("-inf"))])
def test_scalars(text, value):
    assert scenes.scalar(text) == value and type(scenes.scalar(text)) is type(value)


@pytest.mark.parametrize("body", ["a: &x 1", "a: *x", "<<: {b: 1}", "a: {b: 1", "a: 'open", "? a\n: b", "a:\n\tb: 1", "a: !t 1"])
def test_rejected(body):
    (d,) = scenes.documents("--- !u!1 &1\nT:\n" + "\n".join("  " + x for x in body.split("\n")))
    assert d["error"]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.text(max_size=8) | st.floats(allow_nan=False), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=6), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_round_trip(value):
    assert scenes.value_of(scenes.serialize({"T": {"v": value}}).split("\n")) == {"T": {"v": value}}


def node(level, kind, name, flags=0, size=-1):
    return level, kind, name, size, flags


TREE = [node(0, "Thing", "Base"), node(1, "string", "m_Name"), node(2, "Array", "Array", 0x4000), node(3, "int", "size"), node(3, "char", "data"), node(1, "PPtr<Object>", "next"), node(2, "int", "m_FileID"), node(2, "SInt64", "m_PathID"), node(1, "vector", "list"), node(2, "Array", "Array"), node(3, "int", "size"), node(3, "UInt8", "data"), node(1, "float", "f")]


def serialized_file(version=17):
    strings, places, blob = b"", {}, b""
    for level, kind, name, size, flags in TREE:
        at = []
        for text in (kind, name):
            if text not in places:
                places[text] = len(strings)
                strings += text.encode() + b"\0"
            at.append(places[text])
        common = {v: k for k, v in containers.COMMON.items()}
        at = [common[t] | 0x80000000 if t in common else a for t, a in zip((kind, name), at, strict=True)]
        blob += struct.pack("<HBBIIiiI", 1, level, 0, *at, size, 0, flags) + (b"\0" * 8 if version >= 19 else b"")
    body = [struct.pack("<i", 4) + b"Box\0" + struct.pack("<iq", k, 7) + struct.pack("<i", 3) + b"\1\2\3" + struct.pack("<f", 1.5) for k in (0, 1)]
    body[0] = struct.pack("<i", 3) + body[0][4:]
    body[1] = struct.pack("<i", 3) + body[1][4:]
    meta = b"2019.1.0f1\0" + struct.pack("<iB", 5, 1) + struct.pack("<i", 1) + struct.pack("<iBh", 1, 0, -1) + b"h" * 16
    meta += struct.pack("<ii", len(TREE), len(strings)) + blob + strings + (struct.pack("<i", 0) if version >= 21 else b"")
    meta += struct.pack("<i", 2)
    head = 20 if version < 22 else 48
    at = 0
    for k, b in enumerate(body):
        meta += b"\0" * (-(head + len(meta)) % 4)
        meta += struct.pack("<q", 7 + k) + struct.pack("<Q" if version >= 22 else "<I", at) + struct.pack("<Ii", len(b), 0)
        at += len(b)
    meta += struct.pack("<i", 0) + struct.pack("<i", 1) + b"\0" + b"g" * 16 + struct.pack("<i", 3) + b"archive:/other.assets\0"
    meta += (struct.pack("<i", 0) if version >= 20 else b"") + b"user\0"
    offset = head + len(meta)
    size = offset + at
    if version >= 22:
        return struct.pack(">IIII", 0, 0, version, 0) + b"\0\0\0\0" + struct.pack(">Iqqq", len(meta), size, offset, 0) + meta + b"".join(body)
    return struct.pack(">IIII", len(meta), size, version, offset) + b"\0\0\0\0" + meta + b"".join(body)


def web_file(members):
    names = b"".join(struct.pack("<i", len(n)) + n.encode() for n in members)
    head = 16 + 4 + 8 * len(members) + len(names)
    out, at = b"", head
    for n, b in members.items():
        out += struct.pack("<iii", at, len(b), len(n)) + n.encode()
        at += len(b)
    return b"UnityWebData1.0\0" + struct.pack("<i", head) + out + b"".join(members.values())


def bundle(members, method=0, at_end=False):
    raw = b"".join(members.values())
    if method == 1:
        c = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
        stored = bytes([93]) + struct.pack("<I", 1 << 16) + c.compress(raw) + c.flush()
    elif method == 2:
        import pyarrow as pa

        stored = pa.compress(raw, codec="lz4_raw", asbytes=True)
    else:
        stored = raw
    info = b"\0" * 16 + struct.pack(">i", 1) + struct.pack(">IIH", len(raw), len(stored), method) + struct.pack(">i", len(members))
    at = 0
    for n, b in members.items():
        info += struct.pack(">qqI", at, len(b), 4) + n.encode() + b"\0"
        at += len(b)
    head = b"UnityFS\0" + struct.pack(">I", 6) + b"5.x.x\0" + b"2019.1.0f1\0"
    flags = 0x40 | (0x80 if at_end else 0)
    size = len(head) + 20 + len(info) + len(stored)
    head += struct.pack(">qIII", size, len(info), len(info), flags)
    return head + (stored + info if at_end else info + stored)


@pytest.mark.parametrize("version", [17, 19, 21, 22])
def test_serialized_files(version):
    data = serialized_file(version)
    s = containers.serialized(data)
    assert (s.engine, s.version, s.user) == ("2019.1.0f1", version, "user") and s.externals == [((b"g" * 16).hex(), 3, "archive:/other.assets")]
    assert [(o[0], o[3]) for o in s.objects] == [(7, 1), (8, 1)]
    value = containers._value(data, s, s.objects[1])
    assert value == {"m_Name": "Box", "next": {"m_FileID": 1, "m_PathID": 7}, "list": [1, 2, 3], "f": 1.5}
    assert containers._value(data, s, s.objects[0], {"m_Name"}) == {"m_Name": "Box"}
    assert list(containers.pointers(value)) == [("next", 1, 7)]


@pytest.mark.parametrize(("method", "at_end"), [(0, False), (1, False), (2, True)])
def test_bundles(method, at_end):
    own = {"a": b"x" * 500, "b": b"yz" * 100}
    kind, found = containers.members(bundle(own, method, at_end))
    assert kind == "AssetBundle" and dict(found) == own


def test_nested_members(spark, tmp_path):
    inner = bundle({"level0": serialized_file(), "note": b"text"}, 2)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("data/a.bundle", inner)
        f.writestr("web", gzip.compress(web_file({"one": serialized_file(22), "two": b""})))
    (tmp_path / "app.apk").write_bytes(z.getvalue())
    (tmp_path / "broken.bundle").write_bytes(inner[:90])
    rows = {(r.source.rsplit("/", 1)[-1], r.member): (r.kind, r.error) for r in containers.scan_members(spark, str(tmp_path)).collect()}
    assert rows["app.apk", ""] == ("Archive", None) and rows["app.apk", "/data/a.bundle/level0"] == ("SerializedFile", None) and rows["app.apk", "/web/one"] == ("SerializedFile", None)
    assert rows["broken.bundle", ""][1]
    objects = containers.scan_objects(spark, str(tmp_path)).collect()
    assert sorted((r.member, r.path_id, r.name) for r in objects) == [("/data/a.bundle/level0", 7, "Box"), ("/data/a.bundle/level0", 8, "Box"), ("/web/one", 7, "Box"), ("/web/one", 8, "Box")]
    found = containers.scan_pointers(spark, str(tmp_path)).filter("owner = 8").first()
    assert (found.field_path, found.file_id, found.path_id, found.external_path) == ("next", 1, 7, "archive:/other.assets")


def test_scene_scan(spark, tmp_path):
    (tmp_path / "a.prefab").write_text(SCENE)
    (tmp_path / "a.prefab.meta").write_text("fileFormatVersion: 2\nguid: 0123456789abcdef0123456789abcdef\n")
    rows = scenes.scan_objects(spark, str(tmp_path)).orderBy("source", "document_index").collect()
    assert [(r.class_id, r.name, r.stripped, bool(r.error)) for r in rows] == [(1, "It's", False, False), (4, None, True, False), (114, None, False, True), (None, None, False, False)]
    assert json.loads(rows[3].props)["guid"] == "0123456789abcdef0123456789abcdef"
    typed = scenes.scan_objects(spark, str(tmp_path)).filter("class_id = 4").select(F.try_variant_get(F.parse_json("props"), "$.m_LocalPosition.y", "double").alias("y"))
    assert typed.first().y == -1.5
    assert scenes.scan_references(spark, str(tmp_path)).filter("state = 'Valid'").count() == 4


def test_recognition(spark):
    cases = [("a.bin", b"PK\x03\x04x", "Archive"), ("a.png", b"%YAML 1.1", "Yaml"), ("a", b"UnityWebData1.0\0", "WebFile"), ("a", b"UnityFS\0", "AssetBundle"), ("a", b"UnityWeb1234", "AssetBundle"), ("a", serialized_file(), "SerializedFile"), ("a", serialized_file(22), "SerializedFile"),
             ("x.apk", b"", "Archive"), ("x.prefab", b"abc", "YamlOrBinary"), ("x.resS", b"abc", "StreamedResource"), ("x.txt", b"abc", "Unknown"), (None, None, "Unknown")]
    df = spark.createDataFrame([(i, p, None if d is None else bytearray(d)) for i, (p, d, _) in enumerate(cases)], "i int, path string, data binary")
    got = df.select("i", recognition.recognize(F.col("path"), F.coalesce("data", F.lit(b""))).alias("kind")).orderBy("i").collect()
    assert [r.kind for r in got] == [k for *_, k in cases]
