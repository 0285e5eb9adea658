"""Whole texts to token ids with the tokenizers library, fast enough for a corpus.

The library spends most of its time on words it has seen before. For the two pre-tokenizers below, text is
cut where no token can reach across; each chunk's ids are kept, and the library's model is asked only for
chunks that are new. Texts of a batch are cut together and each distinct chunk is looked up once.
Anything unusual goes to the library whole, so ids equal those of ``encode``.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from graphloom.llm import kernel

#: Words kept, about 110 MB a worker at most; later ones are encoded each time.
MOST = 600_000
#: Bytes of text that are cut together; what a batch takes is about thirty times that.
BATCH_BYTES = 3 << 20
#: Python and the library differ on whether these are white space.
_ODD = re.compile("[\x1c-\x1f\x85]")
#: Where the plain split at spaces may cut wrongly: white space that isn't a space or a line feed.
_BLANK = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Above this, Unicode tables of different ages may differ on what a letter is.
_FAR = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _flags(*runs: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in runs:
        out[lo:hi] = True
    return out


#: Bytes that send a text to the careful path: control spaces, and lead bytes of characters from U+1000 on.
_RARE = {"byte": _flags((9, 10), (11, 14), (28, 32), (0xE1, 256)), "word": _flags((28, 32), (0xE1, 256))}
_CUTS = {"byte": _flags((32, 33)), "word": _flags((9, 14), (32, 33))}


class ChunkEncoder:
    """Ids of a text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if vocab <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {}
        self.letters = byte_letters()
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "other"
        if pre.get("type") == "ByteLevel" and not normal and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            self.kind = "byte"
            self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        elif pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            split = pre["pretokenizers"][0]
            steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
            if split.get("invert") and split["behavior"] == "Removed" and steps == ["NFC", "Replace", "Lowercase"]:
                self.kind = "word"
                self.pattern = regex.compile(split["pattern"]["Regex"])
        self.model = self.tokenizer.model
        code = "H" if self.dtype.itemsize == 2 else "I"
        self.pack = lambda *ids: struct.pack(f"<{len(ids)}{code}", *ids)
        self.lead = " " if self.kind == "byte" else ""

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            spelled = piece
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return self.pack(*[t.id for t in self.model.tokenize(spelled)])

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't in ``words``; it is put there unless it's a known word and a mark."""
        head, mark = chunk[:-1], chunk[-1]
        if mark in ".,;:!?" and head.isalpha() and (head.isascii() or not _FAR.search(head)):
            if mark not in self.marks:
                self.marks[mark] = self._piece(mark)
            return (self.words.get(head) or self._new(head)) + self.marks[mark]
        if not chunk.isascii() and _FAR.search(chunk):
            got = self._library(self.lead + chunk)
        elif self.kind == "word":
            plain = chunk.lower() if chunk.isascii() else self.tokenizer.normalizer.normalize_str(chunk)
            got = self._piece(plain) if plain.isalpha() else self._pieces(plain)
        elif not chunk.isalpha():
            got = self._pieces(" " + chunk)
        elif chunk.isascii():
            got = self.pack(*[t.id for t in self.model.tokenize(self.letters[32] + chunk)])
        else:
            got = self._piece(" " + chunk)
        if len(self.words) < MOST:
            self.words[chunk] = got
        return got

    def _each(self, parts: list[str]) -> bytes:
        get, make = self.words.get, self._new
        return b"".join([x if (x := get(p)) is not None else make(p) for p in parts])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "other" or _ODD.search(text) or any(x in text for x in self.added):
            return self._library(text)
        if self.kind == "word":
            return self._each((text.lower() if text.isascii() else text).split())
        # A space between two characters that aren't white space always begins a new piece.
        if "  " in text or " \n" in text or "\n " in text or text[-1] == " " or _BLANK.search(text):
            parts = re.split(r"(?<=\S) (?=\S)", text)
        else:
            parts = text.split(" ")
        head = self._library(parts[0]) if _FAR.search(parts[0]) else self._pieces(parts[0])
        return head + self._each(parts[1:])


    def encode_texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts, in order: all ids, and the n + 1 places where the texts' ids begin. A null is empty."""
        data, offsets = kernel.texts_of(column)
        for lo, hi in kernel.slices(offsets, BATCH_BYTES):
            yield self._together(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def _careful(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts can't be cut at every space."""
        bad = _RARE[self.kind][data]
        if len(data) > 1:
            a, b = data[:-1], data[1:]
            pair = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 60) & (b == 124)
            if self.kind == "byte":
                blank = (data == 32) | (data == 10)
                pair |= blank[:-1] & blank[1:] & ((a == 32) | (b == 32))
            bad[:-1] |= pair
        sums = np.concatenate(([0], np.cumsum(bad, dtype=np.int64)))
        out = sums[offsets[1:]] > sums[offsets[:-1]]
        if self.kind == "byte" and len(data):
            out |= (offsets[1:] > offsets[:-1]) & (data[np.maximum(offsets[1:] - 1, 0)] == 32)
        return out

    def _together(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if self.kind == "other":
            whole = np.ones(n, bool)
            cut = np.zeros(len(data), bool)
        else:
            whole = self._careful(data, offsets)
            cut = _CUTS[self.kind][data] & ~np.repeat(whole, np.diff(offsets))
            if self.kind == "word":
                data = np.where(np.repeat(whole, np.diff(offsets)), data, kernel.LOWER_BYTES[data])
        places = np.flatnonzero(cut)
        sums = np.concatenate(([0], np.cumsum(cut, dtype=np.int64)))
        per_text = sums[offsets[1:]] - sums[offsets[:-1]] + 1
        last = np.cumsum(per_text) - 1
        total = int(per_text.sum())
        is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
        is_first[last + 1 - per_text] = True
        is_last[last] = True
        starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
        starts[is_first], starts[~is_first] = offsets[:-1], places + 1
        ends[is_last], ends[~is_last] = offsets[1:], places
        single = is_first.copy()
        if self.kind == "word":
            single[is_first] = whole
        solid = data[~cut]
        bounds = np.concatenate(([0], np.cumsum(ends - starts)))
        strings = pa.Array.from_buffers(pa.large_string(), total, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(solid.tobytes())])
        coded = strings.filter(pa.array(~single)).dictionary_encode()
        get, make = self.words.get, self._new
        found = [x if (x := get(p)) is not None else make(p) for p in coded.dictionary.to_pylist()]
        code = np.empty(total, np.int32)
        code[~single] = coded.indices.to_numpy()
        code[single] = len(found) + np.arange(int(single.sum()))
        for text, alone in zip(strings.filter(pa.array(single)).to_pylist(), whole if self.kind != "word" else [True] * n, strict=False):
            found.append(self.encode(text) if alone else self._pieces(text))
        size = np.array([len(x) for x in found], np.int64) // self.dtype.itemsize
        ids, at = np.frombuffer(b"".join(found), self.dtype), np.concatenate(([0], np.cumsum(size)))
        counts = size[code]
        stops = np.cumsum(counts)
        shift = (at[code] - stops + counts).astype(np.int32)  # a batch has far fewer than 2**31 ids
        out = ids[np.repeat(shift, counts) + np.arange(stops[-1] if total else 0, dtype=np.int32)]
        return out, np.concatenate(([0], stops[last]))


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a file and worker process, kept until another operator's task begins there."""
    kernel.keeps("tokens", encoder.cache_clear)
    return ChunkEncoder(path)
