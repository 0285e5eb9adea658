"""Textures and sprites: formats, sizes, decoding to RGBA, un-swizzling, PNG and crops, with numpy over whole images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code, name, pixels of a block's sides and bytes of a block.
FORMATS = {
    1: ("Alpha8", 1, 1, 1), 2: ("ARGB4444", 1, 1, 2), 3: ("RGB24", 1, 1, 3), 4: ("RGBA32", 1, 1, 4), 5: ("ARGB32", 1, 1, 4), 7: ("RGB565", 1, 1, 2), 9: ("R16", 1, 1, 2), 10: ("DXT1", 4, 4, 8), 12: ("DXT5", 4, 4, 16),
    13: ("RGBA4444", 1, 1, 2), 14: ("BGRA32", 1, 1, 4), 15: ("RHalf", 1, 1, 2), 16: ("RGHalf", 1, 1, 4), 17: ("RGBAHalf", 1, 1, 8), 18: ("RFloat", 1, 1, 4), 19: ("RGFloat", 1, 1, 8), 20: ("RGBAFloat", 1, 1, 16),
    24: ("BC6H", 4, 4, 16), 25: ("BC7", 4, 4, 16), 26: ("BC4", 4, 4, 8), 27: ("BC5", 4, 4, 16), 34: ("ETC_RGB4", 4, 4, 8), 41: ("EAC_R", 4, 4, 8), 45: ("ETC2_RGB", 4, 4, 8), 47: ("ETC2_RGBA8", 4, 4, 16),
    48: ("ASTC_4x4", 4, 4, 16), 49: ("ASTC_5x5", 5, 5, 16), 50: ("ASTC_6x6", 6, 6, 16), 51: ("ASTC_8x8", 8, 8, 16), 52: ("ASTC_10x10", 10, 10, 16), 53: ("ASTC_12x12", 12, 12, 16), 62: ("RG16", 1, 1, 2), 63: ("R8", 1, 1, 1),
}
DECODABLE = (1, 2, 3, 4, 5, 7, 9, 10, 12, 13, 14, 15, 16, 17, 18, 19, 20, 26, 27, 62, 63)


def size_of(code: int, width: int, height: int, levels: int = 1) -> int:
    """Bytes of a texture with its smaller levels."""
    _, bw, bh, size = FORMATS[code]
    total = 0
    for k in range(levels):
        w, h = max(1, width >> k), max(1, height >> k)
        total += -(-w // bw) * -(-h // bh) * size
    return total


def level_bytes(code: Column, width: Column, height: Column) -> Column:
    """``size_of`` one level as an expression; null for an unknown format."""
    out = F.lit(None).cast("long")
    for k, (_, bw, bh, size) in FORMATS.items():
        out = F.when(code == k, (F.ceil(width / bw) * F.ceil(height / bh) * size).cast("long")).otherwise(out)
    return out


def layout(code: int, width: int, height: int, levels: int, available: int) -> str:
    """ok, or what is wrong with a texture before it is decoded."""
    if code not in FORMATS:
        return "UnknownFormat"
    if not (0 < width <= 16384 and 0 < height <= 16384) or levels < 1:
        return "InvalidSize"
    if size_of(code, width, height) > available:
        return "Truncated"
    return "ok" if code in DECODABLE else "Unsupported"


def _wide(x: np.ndarray, bits: int) -> np.ndarray:
    """Values of a few bits stretched to eight."""
    return (x.astype(np.uint32) * 255 + ((1 << bits) - 1) // 2) // ((1 << bits) - 1)


def _colours(c: np.ndarray) -> np.ndarray:
    return np.stack([_wide(c >> 11 & 31, 5), _wide(c >> 5 & 63, 6), _wide(c & 31, 5)], axis=-1).astype(np.int32)


def _placed(blocks: np.ndarray, width: int, height: int) -> np.ndarray:
    """Blocks (n, 4, 4, channels) in rows of blocks as one image."""
    bw, bh = -(-width // 4), -(-height // 4)
    image = blocks.reshape(bh, bw, 4, 4, -1).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, -1)
    return image[:height, :width]


def _bc1(raw: np.ndarray, opaque: bool) -> np.ndarray:
    """(n, 4, 4, 4) pixels of blocks of 8 bytes: two colours, and two bits a pixel."""
    pair = raw[:, :4].copy().view("<u2").astype(np.uint32)
    a, b = _colours(pair[:, 0]), _colours(pair[:, 1])
    four = (pair[:, 0] > pair[:, 1])[:, None] | opaque
    c = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    d = np.where(four, (a + 2 * b) // 3, 0)
    alpha = np.full((len(raw), 4, 1), 255, np.int32)
    alpha[:, 3, 0] = np.where(four[:, 0], 255, 0)
    table = np.concatenate((np.stack([a, b, c, d], axis=1), alpha), axis=2)
    bits = raw[:, 4:8].copy().view("<u4")[:, 0]
    index = (bits[:, None] >> (2 * np.arange(16, dtype=np.uint32))) & 3
    return np.take_along_axis(table, index[:, :, None].astype(np.int64).repeat(4, axis=2), axis=1).reshape(-1, 4, 4, 4).astype(np.uint8)


def _bc4(raw: np.ndarray) -> np.ndarray:
    """(n, 4, 4) values of blocks of 8 bytes: two values, and three bits a pixel."""
    a, b = raw[:, 0].astype(np.int32), raw[:, 1].astype(np.int32)
    k = np.arange(1, 7)[None, :]
    eight = (a[:, None] * (7 - k) + b[:, None] * k) // 7
    k4 = np.arange(1, 5)[None, :]
    six = np.concatenate(((a[:, None] * (5 - k4) + b[:, None] * k4) // 5, np.zeros((len(a), 1), np.int32), np.full((len(a), 1), 255, np.int32)), axis=1)
    table = np.concatenate((a[:, None], b[:, None], np.where((a > b)[:, None], eight, six)), axis=1)
    bits = np.zeros(len(raw), np.uint64)
    for i in range(6):
        bits |= raw[:, 2 + i].astype(np.uint64) << np.uint64(8 * i)
    index = ((bits[:, None] >> (np.uint64(3) * np.arange(16, dtype=np.uint64))) & np.uint64(7)).astype(np.int64)
    return np.take_along_axis(table, index, axis=1).reshape(-1, 4, 4).astype(np.uint8)


def decode(code: int, width: int, height: int, data: bytes) -> np.ndarray:
    """(height, width, 4) bytes of the largest level, in the stored order of rows; ValueError if it can't be decoded."""
    state = layout(code, width, height, 1, len(data))
    if state != "ok":
        raise ValueError(state)
    raw = np.frombuffer(data, np.uint8, size_of(code, width, height))
    out = np.zeros((height, width, 4), np.uint8)
    out[..., 3] = 255
    pixels = raw.reshape(height, width, -1) if FORMATS[code][1] == 1 else raw
    name = FORMATS[code][0]
    if name == "Alpha8":
        out[..., :3], out[..., 3] = 255, pixels[..., 0]
    elif name == "R8":
        out[..., 0] = pixels[..., 0]
    elif name == "RG16":
        out[..., :2] = pixels
    elif name == "R16":
        out[..., 0] = pixels[..., 1]
    elif name == "RGB24":
        out[..., :3] = pixels
    elif name == "RGBA32":
        out[:] = pixels
    elif name == "ARGB32":
        out[:] = pixels[..., [1, 2, 3, 0]]
    elif name == "BGRA32":
        out[:] = pixels[..., [2, 1, 0, 3]]
    elif name == "RGB565":
        out[..., :3] = _colours(raw.view("<u2").astype(np.uint32)).reshape(height, width, 3)
    elif name in ("ARGB4444", "RGBA4444"):
        v = raw.view("<u2").astype(np.uint32).reshape(height, width)
        shifts = (8, 4, 0, 12) if name == "ARGB4444" else (12, 8, 4, 0)
        out[:] = np.stack([_wide(v >> s & 15, 4) for s in shifts], axis=-1)
    elif name.endswith(("Half", "Float")):
        kind = "<f2" if name.endswith("Half") else "<f4"
        n = len(name) - (4 if name.endswith("Half") else 5)
        v = raw.view(kind).astype(np.float32).reshape(height, width, n)
        out[..., :n] = np.rint(np.clip(np.nan_to_num(v), 0, 1) * 255)
    elif name == "DXT1":
        out[:] = _placed(_bc1(raw.reshape(-1, 8), False), width, height)
    elif name == "DXT5":
        blocks = raw.reshape(-1, 16)
        colour = _bc1(blocks[:, 8:], True)
        colour[..., 3] = _bc4(blocks[:, :8])
        out[:] = _placed(colour, width, height)
    elif name == "BC4":
        out[..., 0] = _placed(_bc4(raw.reshape(-1, 8))[..., None], width, height)[..., 0]
    elif name == "BC5":
        blocks = raw.reshape(-1, 16)
        out[..., 0] = _placed(_bc4(blocks[:, :8])[..., None], width, height)[..., 0]
        out[..., 1] = _placed(_bc4(blocks[:, 8:])[..., None], width, height)[..., 0]
    return out


def unswizzled(data: bytes, width: int, height: int, block_bytes: int, rows_log2: int) -> bytes:
    """Blocks in reading order of a surface stored in tiles of 64 bytes by 8 rows, ``2 ** rows_log2`` tiles high.

    Within a tile, 16-byte units follow the bits of their place: x4 y0 x5 y1 y2 as the address' upper bits.
    """
    pitch = width * block_bytes
    tile = 8 << rows_log2
    across = -(-pitch // 64)
    x, y = np.meshgrid(np.arange(pitch), np.arange(height))
    at = (y // tile * across + x // 64) * 64 * tile + y % tile // 8 * 512
    at += (x % 64 // 32) * 256 + (y % 8 // 2) * 64 + (x % 32 // 16) * 32 + (y % 2) * 16 + x % 16
    raw = np.frombuffer(data, np.uint8)
    if at.size and int(at.max()) >= len(raw):
        raise ValueError("Truncated")
    return raw[at].tobytes()


def flipped(image: np.ndarray) -> np.ndarray:
    """Rows from the top, as stored textures begin at the bottom."""
    return image[::-1]


def png(image: np.ndarray) -> bytes:
    """RGBA pixels as PNG without interlacing or filters."""
    height, width, _ = image.shape
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.concatenate((np.zeros((height, 1), np.uint8), image.reshape(height, width * 4)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def crop(image: np.ndarray, x: float, y: float, width: float, height: float) -> np.ndarray:
    """A sprite's rectangle, whose y counts from the bottom, of an image whose rows count from the top."""
    total, across = image.shape[:2]
    left, right = int(np.floor(x)), int(np.ceil(x + width))
    top, bottom = total - int(np.ceil(y + height)), total - int(np.floor(y))
    if not (0 <= left < right <= across and 0 <= top < bottom <= total):
        raise ValueError("the rectangle lies outside")
    return image[top:bottom, left:right]


def _pngs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for code, width, height, content in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            try:
                rows.append(("ok", png(flipped(decode(code, width, height, content or b"")))))
            except ValueError as e:
                rows.append((str(e), None))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["address", "state", "png"])


def pngs(textures: DataFrame) -> DataFrame:
    """(address, state, png) of textures (address, format, width, height, content)."""
    return textures.select("address", F.col("format").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"), "content").mapInArrow(_pngs, "address string, state string, png binary")
