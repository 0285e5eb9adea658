"""Binary sources: serialized files, bundles, web files and archives; their members, objects and types.

Everything is decoded in Arrow batches from Spark's binary reader. Members that are containers themselves are
opened in turn, down to a bounded depth; what can't be decoded becomes a row with an error.
"""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.scenes import files

MAX_DEPTH, MAX_BYTES = 8, 1 << 30
#: Strings that type trees may name by offset, in the order of their buffer.
COMMON_STRINGS = (
    "AABB", "AnimationClip", "AnimationCurve", "AnimationState", "Array", "Base", "BitField", "bitset", "bool", "char", "ColorRGBA", "Component", "data", "deque", "double", "dynamic_array",
    "FastPropertyName", "first", "float", "Font", "GameObject", "Generic Mono", "GradientNEW", "GUID", "GUIStyle", "int", "list", "long long", "map", "Matrix4x4f", "MdFour", "MonoBehaviour",
    "MonoScript", "m_ByteSize", "m_Curve", "m_EditorClassIdentifier", "m_EditorHideFlags", "m_Enabled", "m_ExtensionPtr", "m_GameObject", "m_Index", "m_IsArray", "m_IsStatic", "m_MetaFlag",
    "m_Name", "m_ObjectHideFlags", "m_PrefabInternal", "m_PrefabParentObject", "m_Script", "m_StaticEditorFlags", "m_Type", "m_Version", "Object", "pair", "PPtr<Component>", "PPtr<GameObject>",
    "PPtr<Material>", "PPtr<MonoBehaviour>", "PPtr<MonoScript>", "PPtr<Object>", "PPtr<Prefab>", "PPtr<Sprite>", "PPtr<TextAsset>", "PPtr<Texture>", "PPtr<Texture2D>", "PPtr<Transform>", "Prefab",
    "Quaternionf", "Rectf", "RectInt", "RectOffset", "second", "set", "short", "size", "SInt16", "SInt32", "SInt64", "SInt8", "staticvector", "string", "TextAsset", "TextMesh", "Texture", "Texture2D",
    "Transform", "TypelessData", "UInt16", "UInt32", "UInt64", "UInt8", "unsigned int", "unsigned long long", "unsigned short", "vector", "Vector2f", "Vector3f", "Vector4f",
    "m_ScriptingClassIdentifier", "Gradient", "Type*", "int2_storage", "int3_storage", "BoundsInt", "m_CorrespondingSourceObject", "m_PrefabInstance", "m_PrefabAsset", "FileSize", "Hash128",
    "RenderingLayerMask", "fixed_array",
)


def _common() -> dict[int, str]:
    out, at = {}, 0
    for s in COMMON_STRINGS:
        out[at] = s
        at += len(s) + 1
    return out


COMMON = _common()


class Cursor:
    def __init__(self, data: bytes, order: str = ">"):
        self.data, self.at, self.order = data, 0, order

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self, code: str) -> int:
        return struct.unpack(self.order + code, self.take(struct.calcsize(self.order + code)))[0]

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode(errors="replace")
        self.at = end + 1
        return out

    def align(self, n: int = 4) -> None:
        self.at += -self.at % n

    def count(self, least: int = 1) -> int:
        n = self.num("i")
        if n < 0 or n * least > len(self.data) - self.at:
            raise ValueError(f"a count of {n}")
        return n


@dataclass
class Node:
    level: int
    kind: str
    name: str
    size: int
    flags: int
    children: list[Node] = field(default_factory=list)


@dataclass
class Kind:
    class_id: int
    script_index: int = -1
    script_id: str | None = None
    tree: Node | None = None
    stripped: bool = False


@dataclass
class Serialized:
    version: int
    engine: str = ""
    platform: int = 0
    order: str = "<"
    data_offset: int = 0
    kinds: list[Kind] = field(default_factory=list)
    objects: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # path id, start, size, class id, kind
    externals: list[tuple[str, int, str]] = field(default_factory=list)  # guid, type, path
    user: str = ""


def has_format(version: int) -> bool:
    return version in (2, 3) or 5 <= version <= 22


def _tree(nodes: list[Node]) -> Node | None:
    stack: list[Node] = []
    for n in nodes:
        if n.level > 512 or (stack and n.level > stack[-1].level + 1) or (not stack and n.level):
            raise ValueError("a type tree's levels")
        del stack[n.level :]
        if stack:
            stack[-1].children.append(n)
        stack.append(n)
    return nodes[0] if nodes else None


def _blob_tree(c: Cursor, version: int) -> Node | None:
    n, size = c.count(24), c.count()
    width = 32 if version >= 19 else 24
    raw, strings = c.take(n * width), None
    strings = c.take(size)

    def name(at: int) -> str:
        if at & 0x80000000:
            return COMMON.get(at & 0x7FFFFFFF, f"?{at & 0x7FFFFFFF}")
        return strings[at : strings.index(b"\0", at)].decode(errors="replace")

    nodes = []
    for k in range(n):
        _, level, _, kind, own, byte_size, _, flags = struct.unpack_from(c.order + "HBBIIiiI", raw, k * width)
        nodes.append(Node(level, name(kind), name(own), byte_size, flags))
    return _tree(nodes)


def _old_tree(c: Cursor, version: int) -> Node | None:
    nodes: list[Node] = []
    todo = [0]
    while todo:
        level = todo.pop()
        if level > 512 or len(nodes) > 1_000_000:
            raise ValueError("a type tree's size")
        kind, name, size = c.text(), c.text(), c.num("i")
        if version == 2:
            c.num("i")
        if version != 3:
            c.num("i")
        c.num("i")  # array flag
        c.num("i")  # version
        flags = c.num("I") if version != 3 else 0
        nodes.append(Node(level, kind, name, size, flags))
        todo += [level + 1] * c.count()
    return _tree(nodes)


def _kind(c: Cursor, version: int, trees: bool, referenced: bool = False) -> Kind:
    out = Kind(c.num("i"))
    if version >= 16:
        out.stripped = bool(c.num("B"))
    if version >= 17:
        out.script_index = c.num("h")
    if version >= 13:
        if (referenced and out.script_index >= 0) or (version < 16 and out.class_id < 0) or (version >= 16 and out.class_id == 114):
            out.script_id = c.take(16).hex()
        c.take(16)
    if trees:
        out.tree = _blob_tree(c, version) if version >= 12 or version == 10 else _old_tree(c, version)
        if version >= 21:
            if referenced:
                for _ in range(3):
                    c.text()
            else:
                c.take(4 * c.count(4))
    return out


def serialized(data: bytes) -> Serialized:
    """Header, types, object table and external table of a serialized file."""
    c = Cursor(data)
    metadata, size, version, offset = (c.num("I") for _ in range(4))
    if not has_format(version):
        raise ValueError(f"format {version}")
    out = Serialized(version)
    if version >= 9:
        endian = c.num("B")
        c.take(3)
        if version >= 22:
            metadata, size, offset = c.num("I"), c.num("q"), c.num("q")
            c.num("q")
    else:
        c.at = size - metadata
        endian = c.num("B")
    if endian > 1 or size > len(data) or offset > size:
        raise ValueError("a header's sizes")
    c.order = out.order = ">" if endian else "<"
    out.data_offset = offset
    if version >= 7:
        out.engine = c.text()
    if version >= 8:
        out.platform = c.num("i")
    trees = bool(c.num("B")) if version >= 13 else True
    for _ in range(c.count()):
        out.kinds.append(_kind(c, version, trees))
    wide_ids = version >= 14 or (version >= 7 and c.num("i") != 0)
    for _ in range(c.count()):
        if version >= 14:
            c.align()
        path_id = c.num("q") if wide_ids else c.num("i")
        start = c.num("q") if version >= 22 else c.num("I")
        length, type_id = c.num("I"), c.num("i")
        kind = type_id if version >= 16 else -1
        class_id = out.kinds[type_id].class_id if version >= 16 and 0 <= type_id < len(out.kinds) else type_id
        if version < 16:
            class_id = c.num("H")
            kind = next((i for i, k in enumerate(out.kinds) if k.class_id == type_id), -1)
        if version < 11:
            c.num("H")
        elif version < 17:
            c.num("h")
        if version in (15, 16):
            c.num("B")
        out.objects.append((path_id, offset + start, length, class_id, kind))
    if version >= 11:
        for _ in range(c.count(8)):
            c.num("i")
            if version >= 14:
                c.align()
            c.num("q" if version >= 14 else "i")
    for _ in range(c.count()):
        if version >= 6:
            c.text()
        guid, kind = (c.take(16).hex(), c.num("i")) if version >= 5 else ("", 0)
        out.externals.append((guid, kind, c.text()))
    if version >= 20:
        for _ in range(c.count()):
            _kind(c, version, trees, True)
    if version >= 5:
        out.user = c.text()
    return out


NUMBERS = {"SInt8": "b", "UInt8": "B", "char": "B", "bool": "?", "short": "h", "SInt16": "h", "unsigned short": "H", "UInt16": "H", "int": "i", "SInt32": "i", "unsigned int": "I", "UInt32": "I", "Type*": "I", "long long": "q", "SInt64": "q", "unsigned long long": "Q", "UInt64": "Q", "FileSize": "Q", "float": "f", "double": "d"}


def read_value(c: Cursor, node: Node, wanted: set[str] | None = None):
    """A value by its type tree. With ``wanted``, reading ends once the top fields named are there: the rest isn't touched."""
    aligned = bool(node.flags & 0x4000)
    if node.kind in NUMBERS:
        out = c.num(NUMBERS[node.kind])
    elif node.kind == "string":
        out = c.take(c.count()).decode(errors="replace")
        aligned = aligned or any(x.flags & 0x4000 for x in node.children)
    elif node.kind == "TypelessData":
        out = c.take(c.count()).hex()
        aligned = aligned or any(x.flags & 0x4000 for x in node.children)
    elif node.children and node.children[0].kind == "Array" or node.kind == "Array":
        array = node if node.kind == "Array" else node.children[0]
        element = array.children[1]
        out = [read_value(c, element) for _ in range(c.count())]  # a map is a list of pairs: order and repeats matter
        aligned = aligned or bool(array.flags & 0x4000)
    else:
        out = {}
        for x in node.children:
            out[x.name] = read_value(c, x)
            if wanted is not None and wanted <= out.keys():
                return out
    if aligned:
        c.align()
    return out


def skip_value(c: Cursor, node: Node) -> None:
    """Moves past a value without making it; arrays of numbers and texts are one step."""
    aligned = bool(node.flags & 0x4000)
    if node.kind in NUMBERS:
        c.take(struct.calcsize("<" + NUMBERS[node.kind]))
    elif node.kind in ("string", "TypelessData"):
        c.take(c.count())
        aligned = aligned or any(x.flags & 0x4000 for x in node.children)
    elif node.children and node.children[0].kind == "Array" or node.kind == "Array":
        array = node if node.kind == "Array" else node.children[0]
        element, n = array.children[1], c.count()
        if element.kind in NUMBERS and not element.flags & 0x4000:
            c.take(n * struct.calcsize("<" + NUMBERS[element.kind]))
        else:
            for _ in range(n):
                skip_value(c, element)
        aligned = aligned or bool(array.flags & 0x4000)
    else:
        for x in node.children:
            skip_value(c, x)
    if aligned:
        c.align()


def same_value(a: Cursor, b: Cursor, node: Node) -> bool:
    """Whether two values of one type are the same, bit by bit, without making either; padding doesn't count.

    Both cursors are moved past their values only if these are the same.
    """
    aligned = bool(node.flags & 0x4000)
    if node.kind in NUMBERS:
        n = struct.calcsize("<" + NUMBERS[node.kind])
        same = a.take(n) == b.take(n)
    elif node.kind in ("string", "TypelessData"):
        same = a.take(a.count()) == b.take(b.count())
        aligned = aligned or any(x.flags & 0x4000 for x in node.children)
    elif node.children and node.children[0].kind == "Array" or node.kind == "Array":
        array = node if node.kind == "Array" else node.children[0]
        n = a.count()
        same = n == b.count() and all(same_value(a, b, array.children[1]) for _ in range(n))
        aligned = aligned or bool(array.flags & 0x4000)
    else:
        same = all(same_value(a, b, x) for x in node.children)
    if same and aligned:
        a.align()
        b.align()
    return same


def traversal_stats(node: Node) -> tuple[int, int, Counter]:
    """Nodes, levels and kinds of a type tree."""
    n, depth, kinds, todo = 0, 0, Counter(), [node]
    while todo:
        x = todo.pop()
        n, depth = n + 1, max(depth, x.level + 1)
        kinds[x.kind] += 1
        todo += x.children
    return n, depth, kinds


def pointers(value, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(field path, file id, path id) of each pointer in a value."""
    if isinstance(value, dict):
        if value.keys() == {"m_FileID", "m_PathID"}:
            yield path, value["m_FileID"], value["m_PathID"]
            return
        for k, v in value.items():
            yield from pointers(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from pointers(v, f"{path}[{i}]")


def decompress(data: bytes, size: int, method: int) -> bytes:
    """By the low six bits of a block's flags: none, LZMA, LZ4 (two of them), Brotli; LZHAM is known but not supported."""
    if size > MAX_BYTES:
        raise ValueError(f"{size} bytes in a block")
    if method == 0:
        return data
    if method == 1:
        props, dictionary = data[0], struct.unpack_from("<I", data, 1)[0]
        filters = [{"id": lzma.FILTER_LZMA1, "dict_size": max(dictionary, 4096), "lc": props % 9, "lp": props // 9 % 5, "pb": props // 45}]
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data[5:], size)
    elif method in (2, 3):
        out = pa.decompress(data, size, codec="lz4_raw", asbytes=True)
    elif method == 5:
        out = pa.decompress(data, size, codec="brotli", asbytes=True)
    else:
        raise ValueError({4: "LZHAM isn't supported"}.get(method, f"compression {method}"))
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes for {size}")
    return out


def bundle(data: bytes, read: bool = True) -> tuple[dict, list[tuple[int, int, int]], list[tuple[str, int, int]], bytes | None]:
    """Header, blocks (raw, stored, flags), members (name, start, size), and the payload of a bundle.

    Without ``read`` the blocks of a bundle with a directory of its own aren't unpacked, and there is no payload.
    """
    c = Cursor(data)
    head = {"signature": c.text(), "version": c.num("I"), "player": c.text(), "engine": c.text()}
    if head["signature"] == "UnityFS" or head["version"] >= 6:
        head["size"] = c.num("q")
        stored, raw, flags = c.num("I"), c.num("I"), c.num("I")
        if head["signature"] != "UnityFS":
            c.num("B")
        if head["version"] >= 7:
            c.align(16)
        head["flags"] = flags
        if flags & 0x80:
            info = data[len(data) - stored :]
        else:
            info = c.take(stored)
        if flags & 0x200:
            c.align(16)
        i = Cursor(decompress(info, raw, flags & 0x3F))
        i.take(16)
        blocks = [(i.num("I"), i.num("I"), i.num("H")) for _ in range(i.count(10))]
        members = []
        for _ in range(i.count(20)):
            start, size = i.num("q"), i.num("q")
            i.num("I")
            members.append((i.text(), start, size))
        if sum(b[0] for b in blocks) > MAX_BYTES:
            raise ValueError("too many bytes in a bundle")
        if not read:
            return head, blocks, members, None
        payload = b"".join(decompress(c.take(b[1]), b[0], b[2] & 0x3F) for b in blocks)
        return head, blocks, members, payload
    if head["version"] >= 4:
        c.take(16)
        c.num("I")
    c.num("I")
    header_size, _, levels = c.num("I"), c.num("I"), c.count(8)
    c.at += 8 * (levels - 1)
    stored, raw = c.num("I"), c.num("I")
    body = data[header_size : header_size + stored]
    payload = body if head["signature"] == "UnityRaw" else lzma.decompress(body, lzma.FORMAT_ALONE)
    d = Cursor(payload)
    members = []
    for _ in range(d.count(9)):
        name = d.text()
        start, size = d.num("I"), d.num("I")
        members.append((name, start, size))
    return head, [(raw, stored, 0)], members, payload


def unzipped(data: bytes) -> bytes:
    """The bytes of a gzip file, read up to the limit only."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        out = f.read(MAX_BYTES + 1)
    if len(out) > MAX_BYTES:
        raise ValueError("too many bytes in a web file")
    return out


def web_file(data: bytes) -> list[tuple[str, int, int]]:
    """Members of a web file whose bytes are ``data``."""
    c = Cursor(data, "<")
    if not c.text().startswith(("UnityWebData", "TuanjieWebData")):
        raise ValueError("not a web file")
    end, out = c.num("i"), []
    while c.at < end:
        start, size = c.num("i"), c.num("i")
        out.append((c.take(c.count()).decode(errors="replace"), start, size))
    return out


def sniff(data: bytes) -> str:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        return "Archive"
    if data[:2] == b"\x1f\x8b" or data[32:38] == b"brotli" or data.startswith((b"UnityWebData", b"TuanjieWebData")):
        return "WebFile"
    if len(data) >= 8 and (data.startswith((b"UnityFS\0", b"UnityRaw", b"UnityWeb"))):
        return "AssetBundle"
    if data.startswith((b"%YAML", b"--- !u!")):
        return "Yaml"
    if len(data) >= 20 and has_format(struct.unpack_from(">I", data, 8)[0]):
        try:
            serialized(data)
            return "SerializedFile"
        except (ValueError, struct.error, IndexError):
            pass
    return "Unknown"


def members(data: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """Kind of a source and its members with their bytes."""
    kind = sniff(data)
    if kind == "Archive":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            own = [x for x in z.infolist() if not x.is_dir()]
            if sum(x.file_size for x in own) > MAX_BYTES:
                raise ValueError("too many bytes in an archive")
            return kind, [(x.filename, z.read(x)) for x in own]
    if kind == "WebFile":
        if data[:2] == b"\x1f\x8b":
            data = unzipped(data)
        elif data[32:38] == b"brotli":
            with pa.input_stream(pa.BufferReader(data), compression="brotli") as f:
                data = f.read(MAX_BYTES + 1)
            if len(data) > MAX_BYTES:
                raise ValueError("too many bytes in a web file")
        return kind, [(n, data[a : a + s]) for n, a, s in web_file(data)]
    if kind == "AssetBundle":
        _, _, own, payload = bundle(data)
        return kind, [(n, payload[a : a + s]) for n, a, s in own]
    return kind, []


def walk(data: bytes, path: str = "", depth: int = 0) -> Iterator[tuple[str, int, str, bytes, str | None]]:
    """(member path, depth, kind, bytes, error) of a source and all it holds, parents first; equal names are numbered."""
    try:
        kind, own = members(data)
        error = None
    except Exception as e:  # a damaged member is a row of its own
        kind, own, error = sniff(data[:16]), [], f"{type(e).__name__}: {e}"
    yield path, depth, kind, data, error
    if depth < MAX_DEPTH:
        seen: Counter = Counter()
        for name, part in own:
            n = seen[name]
            seen[name] += 1
            yield from walk(part, f"{path}/{name}" + (f"#{n}" if n else ""), depth + 1)
    elif own:  # deeper members are named, and why they weren't opened
        for n, (name, part) in enumerate(own):
            yield f"{path}/{name}#{n}", depth + 1, sniff(part[:64]), part, f"deeper than {MAX_DEPTH} levels"


MEMBERS_DDL = "source string, member string, depth int, kind string, bytes long, error string"
LISTED_DDL = "source string, member string, start long, bytes long, signature string, blocks int, raw long, stored long"
OBJECTS_DDL = "source string, member string, engine string, format int, path_id long, class_id int, start long, bytes long, name string"
POINTERS_DDL = "source string, member string, owner long, field_path string, file_id int, path_id long, external_guid string, external_path string"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    cols = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(cols)], names=[n for n, _ in cols])


def _each(batches: Iterator[pa.RecordBatch], ddl: str, rows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield _batch([(path, *r) for r in rows(content.as_py() or b"")], ddl)


def _members(batches):
    yield from _each(batches, MEMBERS_DDL, lambda data: ((p, d, k, len(b), e) for p, d, k, b, e in walk(data)))


def _serialized_members(data: bytes) -> Iterator[tuple[str, bytes, Serialized]]:
    for path, _, kind, part, error in walk(data):
        if kind == "SerializedFile" and not error:
            yield path, part, serialized(part)


def _value(part: bytes, s: Serialized, row: tuple, wanted: set[str] | None = None):
    _, start, size, _, kind = row
    if not 0 <= kind < len(s.kinds) or s.kinds[kind].tree is None:
        return None
    c = Cursor(part[start : start + size], s.order)
    try:
        return read_value(c, s.kinds[kind].tree, wanted)
    except (ValueError, struct.error):
        return None


def _listed(batches):
    def rows(data: bytes):
        head, blocks, own, _ = bundle(data, read=False)
        for name, start, size in own:
            yield name, start, size, head["signature"], len(blocks), sum(b[0] for b in blocks), sum(b[1] for b in blocks)

    yield from _each(batches, LISTED_DDL, lambda data: rows(data) if sniff(data) == "AssetBundle" else ())


def _objects(batches):
    def rows(data: bytes):
        for path, part, s in _serialized_members(data):
            for row in s.objects:
                value = _value(part, s, row, {"m_Name"})
                name = value.get("m_Name") if isinstance(value, dict) else None
                yield path, s.engine, s.version, row[0], row[3], row[1], row[2], name if isinstance(name, str) else None

    yield from _each(batches, OBJECTS_DDL, rows)


def _pointers(batches):
    def rows(data: bytes):
        for path, part, s in _serialized_members(data):
            for row in s.objects:
                for where, file_id, path_id in pointers(_value(part, s, row)):
                    guid, _, place = s.externals[file_id - 1] if 0 < file_id <= len(s.externals) else (None, 0, None)
                    yield path, row[0], where, file_id, path_id, guid, place

    yield from _each(batches, POINTERS_DDL, rows)


def scan_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row a source and member, nested ones too."""
    return files(spark, path, pattern).mapInArrow(_members, MEMBERS_DDL)


def list_bundles(spark: SparkSession, path: str, pattern: str = "*", contains: str = "") -> DataFrame:
    """The members of every bundle, by its directory alone, with those whose name holds a text; payloads aren't unpacked."""
    listed = files(spark, path, pattern).mapInArrow(_listed, LISTED_DDL)
    return listed.filter(F.contains(F.lower("member"), F.lit(contains.lower()))) if contains else listed


def scan_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row an object of every serialized file, with its name where the type is known; values aren't read beyond it."""
    return files(spark, path, pattern).mapInArrow(_objects, OBJECTS_DDL)


def scan_pointers(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row a pointer of every object whose type is known, with its external identity."""
    return files(spark, path, pattern).mapInArrow(_pointers, POINTERS_DDL)
