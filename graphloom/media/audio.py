"""Audio clips: formats, layout of a clip, and whether a WAVE payload is what it says."""

from __future__ import annotations

import struct

#: Codes of stored formats and their names.
FORMATS = {0: "PCM", 1: "Vorbis", 2: "ADPCM", 3: "MP3", 4: "VAG", 5: "HEVAG", 6: "XMA", 7: "AAC", 8: "GCADPCM", 9: "ATRAC9"}


def layout(clip: dict) -> tuple[str, str | None]:
    """State and format of a clip: Streamed if its bytes lie elsewhere, Embedded if it holds them, else what is wrong."""
    code = clip.get("m_CompressionFormat")
    if code not in FORMATS:
        return "UnknownFormat", None
    if not 0 < clip.get("m_Channels", 0) <= 64 or not 0 < clip.get("m_Frequency", 0) <= 768_000:
        return "InvalidLayout", FORMATS[code]
    resource = clip.get("m_Resource") or {}
    if resource.get("m_Source"):
        if resource.get("m_Offset", -1) < 0 or resource.get("m_Size", 0) <= 0:
            return "InvalidRange", FORMATS[code]
        return "Streamed", FORMATS[code]
    return ("Embedded" if clip.get("m_AudioData") else "Empty"), FORMATS[code]


def wave_state(data: bytes) -> str:
    """ok, or the first thing that is wrong with a WAVE file: container, chunks, format or data."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return "NotWave"
    if struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
        return "Truncated"
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            return "Truncated"
        if name in found:
            return "RepeatedChunk"
        found[name] = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    head = found.get(b"fmt ", b"")
    if len(head) < 16:
        return "NoFormat"
    kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", head)
    if kind not in (1, 3, 0xFFFE) or not channels or not rate or bits not in (8, 16, 24, 32, 64) or align != channels * bits // 8 or per_second != rate * align:
        return "InvalidFormat"
    if b"data" not in found:
        return "NoData"
    return "ok" if len(found[b"data"]) % align == 0 else "PartialFrame"
