"""Media columns: payloads stored as 8-bit WAV, read back by the wave module, and audio fingerprints.

A fingerprint is the list of spectral-peak pairs of a short-time Fourier transform: for a peak and the
peaks soon after it, a code of both frequencies and their distance, with the time of the first one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
HOP = 288
RATE = 8000
#: Frequency bins of the bands that give one peak a frame.
BANDS = ((1, 24), (24, 96), (96, FRAME // 2 + 1))
FAN_OUT, REACH = 2, 6
_window = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of the frame."""
    return data + b"\xff" * (FRAME - len(data) if not data else -len(data) % FRAME)


def to_wav(payload: bytes) -> bytes:
    """The payload as one channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file that ``to_wav`` made."""
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return f.readframes(f.getnframes())


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (in hops) and codes of the spectral-peak pairs, by time.

    Magnitudes are rounded to steps of a quarter octave before they are compared, and ties go to the lower
    bin, so equal samples give equal pairs.
    """
    wave_form = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = (len(wave_form) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    frames = np.lib.stride_tricks.as_strided(wave_form, (n, FRAME), (wave_form.strides[0] * HOP, wave_form.strides[0]), writeable=False)
    level = np.rint(4 * np.log2(1 + np.abs(np.fft.rfft(frames * _window, axis=1)))).astype(np.int16)
    times, bins = [], []
    for lo, hi in BANDS:
        top = lo + level[:, lo:hi].argmax(axis=1)
        height = level[np.arange(n), top]
        kept = np.ones(n, bool)  # a peak is at least as high as its band's peak a frame before, and higher than the next
        kept[1:] &= height[1:] >= height[:-1]
        kept[:-1] &= height[:-1] > height[1:]
        times.append(np.flatnonzero(kept))
        bins.append(top[kept])
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    at, code = [], []
    for k in range(1, FAN_OUT + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        at.append(t[:-k][near])
        code.append((f[:-k][near] << 18) | (f[k:][near] << 6) | gap[near])
    at_all, code_all = np.concatenate(at).astype(np.uint32), np.concatenate(code).astype(np.uint32)
    order = np.lexsort((code_all, at_all))
    return at_all[order], code_all[order]


STORED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
STORED_DDL = "id long, n_bytes long, media binary"
FEATURES_DDL = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, len(texts), 512):
            own = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts[lo : lo + 512].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], pa.array(map(len, own), pa.int64()), pa.array([to_wav(padded(x)) for x in own], pa.binary())], schema=STORED)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(2).to_pylist():
            if media is None:
                rows.append((None,) * 7)
                continue
            payload = from_wav(media)
            times, codes = peak_pairs(payload)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), times, codes))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _features(_stored(batches))


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: the UTF-8 bytes of each text, padded and stored as WAV. A null text is empty."""
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_stored, STORED_DDL)


def fingerprints(media: DataFrame) -> DataFrame:
    """What the stored media of (id, n_bytes, media) holds: digests and peak pairs as time-coded arrays.

    Null media give nulls; a repeated row is kept; an empty table gives no rows.
    """
    return media.select("id", "n_bytes", "media").mapInArrow(_features, FEATURES_DDL)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprints(media_column(df))`` in one pass, without sending the media through the JVM."""
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_both, FEATURES_DDL)
