"""Writers of binary containers: web files, bundles and serialized files, and the compressors that they use.

They are the inverse of the readers beside them. A container is one file, so it is made by one task from the bytes of
its members; many of them are made in parallel, one row each.
"""

from __future__ import annotations

import gzip
import lzma
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Compression by the low bits of a block's flags.
METHODS = {"none": 0, "lzma": 1, "lz4": 2, "lz4hc": 3}
BLOCK = 128 * 1024


def packing(policy: str) -> tuple[str, str]:
    """Compression of a bundle's directory and blocks: none, lz4, lzma, original, or directory:blocks."""
    if policy == "original":
        return "original", "original"
    info, colon, blocks = policy.partition(":")
    parts = (info, blocks) if colon else (("lz4", "lzma") if policy == "lzma" else (policy, policy))
    if any(p not in METHODS for p in parts):
        raise ValueError(f"packing {policy!r}")
    return parts


def lz4(data: bytes) -> bytes:
    return pa.compress(data, codec="lz4_raw", asbytes=True)


def lzma_raw(data: bytes) -> bytes:
    """Five bytes of properties, then the stream without an end mark."""
    filters = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 19, "lc": 3, "lp": 0, "pb": 2}]
    return bytes([(2 * 5 + 0) * 9 + 3]) + struct.pack("<I", 1 << 19) + lzma.compress(data, lzma.FORMAT_RAW, filters=filters)


def compress(data: bytes, method: str) -> bytes:
    if method == "none":
        return data
    if method in ("lz4", "lz4hc"):
        return lz4(data)
    if method == "lzma":
        return lzma_raw(data)
    raise ValueError(method)


def _padded(data: bytes, to: int) -> bytes:
    return data + b"\0" * (-len(data) % to)


def web_file(members: Sequence[tuple[str, bytes]], zipped: bool = False) -> bytes:
    """Names and ranges of the members, then their bytes one after the other."""
    names = [n.encode() for n, _ in members]
    at = 16 + 4 + sum(12 + len(n) for n in names)
    head = b"UnityWebData1.0\0" + struct.pack("<i", at)
    for name, (_, data) in zip(names, members, strict=True):
        head += struct.pack("<iii", at, len(data), len(name)) + name
        at += len(data)
    out = head + b"".join(data for _, data in members)
    return gzip.compress(out, mtime=0) if zipped else out


def bundle(members: Sequence[tuple[str, bytes]], policy: str = "lz4", engine: str = "2020.3.1f1", version: int = 7) -> bytes:
    """A bundle whose payload is cut into blocks; a block that doesn't shrink is stored as it is."""
    info_method, block_method = packing(policy)
    payload = b"".join(data for _, data in members)
    blocks = []
    for at in range(0, len(payload), BLOCK):
        raw = payload[at : at + BLOCK]
        packed = compress(raw, block_method)
        blocks.append((raw, packed, METHODS[block_method]) if len(packed) < len(raw) else (raw, raw, 0))
    info = b"\0" * 16 + struct.pack(">I", len(blocks))
    info += b"".join(struct.pack(">IIH", len(raw), len(packed), flags) for raw, packed, flags in blocks)
    info += struct.pack(">I", len(members))
    at = 0
    for name, data in members:
        info += struct.pack(">qqI", at, len(data), 4) + name.encode() + b"\0"
        at += len(data)
    stored = compress(info, info_method)
    head = b"UnityFS\0" + struct.pack(">I", version) + b"5.x.x\0" + engine.encode() + b"\0"
    size_at = len(head)
    head += struct.pack(">qIII", 0, len(stored), len(info), METHODS[info_method] | 0x40)
    if version >= 7:
        head = _padded(head, 16)
    out = head + stored + b"".join(packed for _, packed, _ in blocks)
    return out[:size_at] + struct.pack(">q", len(out)) + out[size_at + 8 :]


def serialized(data: bytes, changed: dict[int, bytes]) -> bytes:
    """A serialized file with other bytes for some of its objects, by path id; header, types and tables stay.

    Objects are laid out anew in their order, each at a multiple of eight; KeyError for an id that the file hasn't.
    """
    from graphloom.sources.containers import serialized as read

    s = read(data)
    if missing := set(changed) - {o[0] for o in s.objects}:
        raise KeyError(min(missing))
    order, wide = s.order, s.version >= 22
    body, places = b"", {}
    for path_id, start, size, _, _ in s.objects:
        body = _padded(body, 8)
        own = changed.get(path_id, data[start : start + size])
        places[path_id] = (len(body), len(own))
        body += own
    head = bytearray(data[: s.data_offset])
    for path_id, start, size, _, _ in s.objects:
        before = struct.pack(order + ("qqI" if wide else "qII") if s.version >= 14 else order + "iII", path_id, start - s.data_offset, size)
        at = bytes(head).find(before)
        if at < 0:
            raise ValueError("an object isn't in the table")
        head[at : at + len(before)] = struct.pack(order + ("qqI" if wide else "qII") if s.version >= 14 else order + "iII", path_id, *places[path_id])
    out = bytes(head) + body
    if wide:
        return out[:24] + struct.pack(">q", len(out)) + out[32:]
    return out[:4] + struct.pack(">I", len(out)) + out[8:]


def streamed_resource(parts: Sequence[bytes], align: int = 16) -> tuple[bytes, list[tuple[int, int]]]:
    """Streamed payloads one after the other, and where each lies."""
    out, places = b"", []
    for part in parts:
        out = _padded(out, align)
        places.append((len(out), len(part)))
        out += part
    return out, places


def _encode(kind: str, policy: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for members in batch.column(1).to_pylist():
                own = [(m["name"], m["content"] or b"") for m in members]
                rows.append(web_file(own, policy == "gzip") if kind == "web_file" else bundle(own, policy))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["container", "content"])

    return encode


def containers(members: DataFrame, kind: str = "bundle", policy: str = "lz4") -> DataFrame:
    """(container, content) of many containers at once. members: container, ordinal, name, content; a container must fit a task."""
    own = members.groupBy("container").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "content"))).alias("members"))
    return own.select(F.col("container").cast("string"), "members").mapInArrow(_encode(kind, policy), "container string, content binary")
