"""Writers of containers against their readers, schema registries, textures and audio, made here byte by byte."""

from __future__ import annotations

import io
import json
import lzma
import struct
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_sources import TREE, bundle, serialized_file

from graphloom.media import audio, textures
from graphloom.operators import inventory
from graphloom.sources import containers, encoders, registries


@pytest.mark.parametrize("policy", ["none", "lz4", "lzma", "none:lz4", "lz4hc"])
def test_bundles_round_trip(policy):
    own = [("CAB-1", b"abc" * 90_000), ("CAB-1.resS", bytes(range(256)) * 900), ("empty", b"")]
    data = encoders.bundle(own, policy)
    kind, found = containers.members(data)
    assert kind == "AssetBundle" and found == own
    head, blocks, listed, payload = containers.bundle(data, read=False)
    assert payload is None and [n for n, *_ in listed] == [n for n, _ in own] and head["size"] == len(data)
    assert encoders.packing("lzma") == ("lz4", "lzma") and encoders.packing("original") == ("original", "original")
    with pytest.raises(ValueError):
        encoders.packing("zip")


@pytest.mark.parametrize("zipped", [False, True])
def test_web_files_round_trip(zipped):
    own = [("a/b", b"x"), ("ü", b""), ("c", b"yz" * 500)]
    assert containers.members(encoders.web_file(own, zipped)) == ("WebFile", own)
    raw = encoders.web_file(own)
    packed = pa.compress(raw, codec="brotli", asbytes=True)
    assert containers.sniff(b"\0" * 32 + b"brotli") == "WebFile" and len(packed)


@pytest.mark.parametrize("version", [17, 21, 22])
def test_serialized_files_with_other_objects(version):
    data = serialized_file(version)
    s = containers.serialized(data)
    _, start, size, _, _ = s.objects[1]
    value = data[start : start + size]
    longer = value[:4] + struct.pack("<i", 0)[:0] + value[4:]
    longer = struct.pack("<i", 7) + b"Boxes!!" + b"\0" + value[8:]
    out = encoders.serialized(data, {8: longer})
    t = containers.serialized(out)
    assert containers._value(out, t, t.objects[0]) == containers._value(data, s, s.objects[0])
    assert containers._value(out, t, t.objects[1])["m_Name"] == "Boxes!!" and t.externals == s.externals
    with pytest.raises(KeyError):
        encoders.serialized(data, {99: b""})


def test_values_are_skipped_and_compared():
    data = serialized_file()
    s = containers.serialized(data)
    a, b = (data[o[1] : o[1] + o[2]] for o in s.objects)
    tree = s.kinds[0].tree
    c = containers.Cursor(b, s.order)
    containers.skip_value(c, tree)
    d = containers.Cursor(b, s.order)
    containers.read_value(d, tree)
    assert c.at == d.at == len(b)
    same = lambda x, y: containers.same_value(containers.Cursor(x, s.order), containers.Cursor(y, s.order), tree)
    assert same(b, b) and not same(a, b) and same(b, b[:7] + b"\xff" + b[8:])  # byte 7 is padding
    assert containers.traversal_stats(tree)[:2] == (len(TREE), 4)


def test_members_too_deep_are_named(monkeypatch):
    monkeypatch.setattr(containers, "MAX_DEPTH", 1)
    inner = bundle({"deep": b"x"})
    rows = list(containers.walk(bundle({"a": bundle({"b": inner})})))
    assert [(p, d, e) for p, d, _, _, e in rows if e] == [("/a/b#0", 2, "deeper than 1 levels")]


def test_many_containers_and_their_listing(spark, tmp_path):
    rows = [(f"c{i}", k, f"m{k}", bytearray(b"z" * k)) for i in range(3) for k in range(4)]
    made = encoders.containers(spark.createDataFrame(rows, "container string, ordinal int, name string, content binary")).collect()
    for r in made:
        assert containers.members(bytes(r.content))[1] == [(f"m{k}", b"z" * k) for k in range(4)]
        (tmp_path / f"{r.container}.bundle").write_bytes(r.content)
    listed = containers.list_bundles(spark, str(tmp_path), contains="M3")
    assert {(r.source.rsplit("/", 1)[-1], r.bytes) for r in listed.collect()} == {(f"c{i}.bundle", 3) for i in range(3)}
    assert encoders.streamed_resource([b"abc", b"de"])[1] == [(0, 3), (16, 2)]


def test_registries(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"schemas": [{"class_id": 1, "version": "5.1.2", "nodes": ["a"]}, {"class_id": 1, "version": "5.*", "nodes": ["b"]}, {"class_id": 1, "nodes": ["c"]}]}))
    tree = {"TypeName": "GameObject", "Name": "Base", "Level": 0, "SubNodes": []}
    (tmp_path / "info.json").write_text(json.dumps({"Version": "6.0.0", "Classes": [{"TypeID": 2, "Name": "A", "IsAbstract": True}, {"TypeID": 1, "Name": "B", "IsAbstract": False, "ReleaseRootNode": tree}]}))
    registry = registries.from_json(spark, f"{tmp_path}/r.json").union(registries.from_class_export(spark, f"{tmp_path}/info.json", 1))
    objects = spark.createDataFrame([("a", 1, "5.1.2"), ("b", 1, "5.9"), ("c", 1, "6.0.0"), ("d", 2, "6.0.0")], "address string, class_id int, version string")
    got = {r.address: r.schema for r in inventory.registry_match(objects, registry).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == ('["a"]', '["b"]', '["c"]', None)
    assert json.loads(registry.filter("source = 1").first().schema)["TypeName"] == "GameObject"


def test_packages():
    body = b"tree" * 100
    raw = lzma.compress(body, lzma.FORMAT_ALONE)
    head = lambda method, packed: b"TPK*" + bytes([1, method]) + b"\0" * 10 + struct.pack("<ii", len(packed), len(body)) + packed
    for method, packed in ((0, body), (1, pa.compress(body, codec="lz4_raw", asbytes=True)), (2, raw[:5] + raw[13:]), (3, pa.compress(body, codec="brotli", asbytes=True))):
        assert registries.package(head(method, packed)) == body
    for bad in (b"", head(0, body)[:-1], head(9, body), b"XPK*" + head(0, body)[4:]):
        with pytest.raises(ValueError):
            registries.package(bad)


def test_plain_textures():
    px = lambda code, data: textures.decode(code, 1, 1, data)[0, 0].tolist()
    assert px(4, bytes([1, 2, 3, 4])) == [1, 2, 3, 4] and px(5, bytes([4, 1, 2, 3])) == [1, 2, 3, 4] and px(14, bytes([3, 2, 1, 4])) == [1, 2, 3, 4] and px(3, bytes([1, 2, 3])) == [1, 2, 3, 255]
    assert px(1, b"\x07") == [255, 255, 255, 7] and px(63, b"\x09") == [9, 0, 0, 255] and px(7, struct.pack("<H", 0xF800)) == [255, 0, 0, 255] and px(13, struct.pack("<H", 0x1234)) == [17, 34, 51, 68]
    assert px(2, struct.pack("<H", 0x4123)) == [17, 34, 51, 68] and px(20, struct.pack("<4f", 1, 0.5, -1, float("nan"))) == [255, 128, 0, 0] and px(17, np.array([1, 0, 0, 1], "<f2").tobytes()) == [255, 0, 0, 255]


def slow_bc1(block, opaque):
    a, b, bits = struct.unpack("<HHI", block)
    wide = lambda v, n: (v * 255 + ((1 << n) - 1) // 2) // ((1 << n) - 1)
    rgb = [(wide(c >> 11, 5), wide(c >> 5 & 63, 6), wide(c & 31, 5)) for c in (a, b)]
    if a > b or opaque:
        table = [(*rgb[0], 255), (*rgb[1], 255), *[tuple((x * (2 - k) + y * (1 + k)) // 3 for x, y in zip(*rgb, strict=True)) + (255,) for k in (0, 1)]]
    else:
        table = [(*rgb[0], 255), (*rgb[1], 255), tuple((x + y) // 2 for x, y in zip(*rgb, strict=True)) + (255,), (0, 0, 0, 0)]
    return [[list(table[bits >> 2 * (4 * y + x) & 3]) for x in range(4)] for y in range(4)]


def slow_bc4(block):
    a, b, bits = block[0], block[1], int.from_bytes(block[2:], "little")
    table = [a, b, *[(a * (7 - k) + b * k) // 7 for k in range(1, 7)]] if a > b else [a, b, *[(a * (5 - k) + b * k) // 5 for k in range(1, 5)], 0, 255]
    return [[table[bits >> 3 * (4 * y + x) & 7] for x in range(4)] for y in range(4)]


def test_block_textures():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 16 * 6, np.uint8).tobytes()
    one, five = textures.decode(10, 7, 6, raw[:32]), textures.decode(12, 10, 5, raw)
    for y in range(6):
        for x in range(7):
            k = y // 4 * 2 + x // 4
            assert one[y, x].tolist() == slow_bc1(raw[8 * k : 8 * k + 8], False)[y % 4][x % 4]
    for y in range(5):
        for x in range(10):
            k = y // 4 * 3 + x // 4
            block = raw[16 * k : 16 * k + 16]
            assert five[y, x].tolist() == [*slow_bc1(block[8:], True)[y % 4][x % 4][:3], slow_bc4(block[:8])[y % 4][x % 4]]
    assert textures.decode(27, 4, 4, raw[:16])[..., 1].tolist() == slow_bc4(raw[8:16])
    assert [textures.layout(c, 4, 4, 1, n) for c, n in ((999, 9), (25, 16), (12, 15), (12, 16))] == ["UnknownFormat", "Unsupported", "Truncated", "ok"]
    assert textures.size_of(12, 8, 8, 4) == 64 + 16 + 16 + 16


def test_pngs_and_sprites(spark):
    image = np.arange(3 * 2 * 4, dtype=np.uint8).reshape(2, 3, 4)
    data = textures.png(image)
    at, parts = 8, {}
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(name + body)
        parts[name], at = body, at + 12 + n
    assert parts[b"IHDR"][:8] == struct.pack(">II", 3, 2)
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(2, 13)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(2, 3, 4) == image).all()
    assert textures.crop(image, 1, 0, 2, 1).tolist() == image[1:2, 1:3].tolist()
    with pytest.raises(ValueError):
        textures.crop(image, 2, 0, 2, 1)
    df = spark.createDataFrame([("a", 4, 3, 2, bytearray(image[::-1].tobytes())), ("b", 25, 4, 4, bytearray(16)), ("c", 4, 9, 9, None)], "address string, format int, width int, height int, content binary")
    got = {r.address: (r.state, r.png) for r in textures.pngs(df).collect()}
    assert got["a"] == ("ok", bytearray(data)) and got["b"][0] == "Unsupported" and got["c"][0] == "Truncated"


def test_unswizzling():
    pitch, height = 128, 32
    raw = bytes(np.random.default_rng(2).integers(0, 256, pitch * height, np.uint8))
    out = textures.unswizzled(raw, 32, height, 4, 1)
    assert sorted(out) == sorted(raw) and out[:16] == raw[:16] and out[16:32] == raw[32:48] and out[pitch : pitch + 16] == raw[16:32]
    with pytest.raises(ValueError):
        textures.unswizzled(raw[:100], 32, height, 4, 1)


def test_audio():
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"\0" * 400)
    data = buffer.getvalue()
    assert audio.wave_state(data) == "ok" and audio.wave_state(data[:-3]) == "Truncated" and audio.wave_state(b"x") == "NotWave"
    assert audio.wave_state(data[:32] + b"\7\0" + data[34:]) == "InvalidFormat"
    clip = {"m_CompressionFormat": 1, "m_Channels": 2, "m_Frequency": 44100, "m_Resource": {"m_Source": "a.resS", "m_Offset": 0, "m_Size": 10}}
    assert audio.layout(clip) == ("Streamed", "Vorbis") and audio.layout(clip | {"m_CompressionFormat": 77})[0] == "UnknownFormat"
    assert audio.layout(clip | {"m_Resource": {"m_Source": "a", "m_Offset": -1, "m_Size": 1}})[0] == "InvalidRange" and audio.layout(clip | {"m_Resource": None})[0] == "Empty"


def test_tree_statistics(spark):
    rows = spark.createDataFrame([("s", 0, "A"), ("s", 1, "B"), ("s", 1, "B")], "schema string, level int, kind string")
    assert registries.tree_stats(rows).first()[1:] == (3, 1, 2)
    assert registries.merged_stats(registries.tree_stats(rows)).first().nodes == 3
    huge = spark.createDataFrame([(2**63 - 1, 1), (1, 1)], "nodes long, depth int")
    with pytest.raises(Exception, match="overflows"):
        registries.merged_stats(huge).select(F.col("nodes")).collect()
