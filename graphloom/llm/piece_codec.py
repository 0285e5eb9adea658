"""SentencePiece encoding and decoding for byte-pair models, by suffix-array matching.

The distinct chunks of a batch (a run of spaces and the word after it; no piece reaches further, which is
verified when a model is read) are concatenated, and the suffixes of that text are sorted by as many characters
as the longest piece has. Every piece is then looked up by binary search, which gives the range of suffixes that
begin with it: its occurrences, the edges. They are laid out by position and length, and relaxed: of the edges of
a chunk that join two neighbouring tokens, the one of the best score (the leftmost among equals) is taken, until
there is none. This is what the model's merges do, for all chunks of the batch at once.

Chunks that were seen before keep their ids in a bounded table. Characters without a piece become byte pieces,
or the unknown piece if the model has none. The model's file is read by the sentencepiece library; encoding and
decoding don't use it.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernel

SPACE = "▁"
#: Chunks kept, about 150 MB a worker at most; characters that are matched together; texts cut together, in bytes.
MOST, BATCH_CHARS, BATCH_BYTES = 700_000, 1 << 20, 4 << 20
#: Longer chunks are relaxed one by one with a heap, as the rounds for all chunks would be many.
LONG_CHUNK = 48
NONE = np.uint16(65535)


class PieceCodec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n >= int(NONE):
            raise ValueError("more pieces than two bytes can number")
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space after another character")
        self.unknown = model.unk_id()
        self.bytes_of = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.single = {pieces[i]: i for i in plain if len(pieces[i]) == 1}
        longer = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: (-model.get_score(i), i))
        self.id_of_rank = np.array(longer, np.uint16)
        self.longest = max((len(pieces[i]) for i in longer), default=2)
        self.letters = np.array(sorted({ord(c) for i in longer for c in pieces[i]}), np.uint32)
        bits = max(1, int(len(self.letters) + 1).bit_length())
        self.bits, self.per_word = bits, 62 // bits
        self.n_words = -(-self.longest // self.per_word)
        codes = [self._codes(pieces[i]) for i in longer]
        self.length = np.array([len(c) for c in codes], np.int64)
        padded = lambda fill: np.array([[*c, *[fill] * (self.n_words * self.per_word - len(c))] for c in codes], np.uint64).reshape(len(codes), -1)
        self.low, self.high = self._keys(padded(0)), self._keys(padded((1 << bits) - 1))
        spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        self.chunks: dict[str, bytes] = {}

    def _codes(self, text: str) -> np.ndarray:
        """A number from 1 for each character that longer pieces have, 0 for others."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0)

    def _keys(self, symbols: np.ndarray) -> list[np.ndarray]:
        """Symbols (rows x longest) packed into words that compare like them."""
        out = []
        for w in range(self.n_words):
            key = np.zeros(len(symbols), np.uint64)
            for k in range(w * self.per_word, (w + 1) * self.per_word):
                key = key << np.uint64(self.bits) | symbols[:, k]
            out.append(key)
        return out

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The suffix array of a text, by as many characters as the longest piece has, and its sorted keys."""
        n, width = len(codes), self.n_words * self.per_word
        tail = np.concatenate((codes, np.zeros(width, codes.dtype))).astype(np.uint64)
        word = np.zeros(n + width, np.uint64)
        for k in range(self.per_word):
            word[: n + width - k] |= tail[k:] << np.uint64(self.bits * (self.per_word - 1 - k))
        words = [word[w * self.per_word : w * self.per_word + n] for w in range(self.n_words)]
        order = np.lexsort(words[::-1])
        return order, [w[order] for w in words]

    def _search(self, keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Where each wanted key would stand in the sorted keys, by binary search of all of them together."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = np.minimum(mid, len(keys[0]) - 1)
            before, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, w in zip(keys, wanted, strict=True):
                here = k[at]
                before |= equal & (here < w)
                equal &= here == w
            go = open_ & (before | (equal if right else False))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """Rank of the piece at each position and length (from 2), or NONE."""
        order, keys = self._suffixes(codes)
        lo, hi = self._search(keys, self.low, False), self._search(keys, self.high, True)
        count = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(count)), count)
        place = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        table = np.full(len(codes) * (self.longest - 1), NONE, np.uint16)
        table[place * (self.longest - 1) + self.length[piece] - 2] = piece.astype(np.uint16)
        return table

    def _relax(self, table: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> None:
        """Takes edges in all chunks together, one a chunk and round; clears ``starts`` where tokens were joined."""
        sizes = np.diff(bounds)
        tokens = np.flatnonzero(starts[:-1])
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        width = self.longest - 1
        ends = np.append(tokens[1:], bounds[-1])
        while len(tokens) > 1:
            after = np.append(ends[1:], ends[-1])
            span = after - tokens
            joined = np.zeros(len(tokens), bool)
            joined[:-1] = chunk[:-1] == chunk[1:]
            joined &= span <= self.longest
            rank = np.full(len(tokens), int(NONE), np.int64)
            rank[joined] = table[tokens[joined] * width + span[joined] - 2]
            first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(tokens)), first)
            live = (best >> 32) < int(NONE)
            if not live.any():
                return
            at = (best & 0xFFFFFFFF)[live]
            starts[tokens[at + 1]] = False
            ends[at] = ends[at + 1]
            keep = np.repeat(live, np.diff(np.append(first, len(tokens))))
            keep[at + 1] = False
            tokens, ends, chunk = tokens[keep], ends[keep], chunk[keep]

    def _relax_long(self, table: np.ndarray, lo: int, hi: int, starts: np.ndarray) -> None:
        """The same for one long chunk, with a heap of its edges."""
        width = self.longest - 1
        after = {i: i + 1 for i in range(lo, hi)}
        before = {i: i - 1 for i in range(lo, hi)}
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after.get(i, hi)
            if i >= lo and j < hi and (e := after[j]) - i <= self.longest and (rank := int(table[i * width + e - i - 2])) != int(NONE):
                heapq.heappush(heap, (rank, i, e))

        for i in range(lo, hi - 1):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after.get(i, hi)
            if j >= hi or after.get(j) != e or not starts[i]:
                continue
            starts[j] = False
            after[i] = e
            del after[j]
            if e < hi:
                before[e] = i
            offer(i)
            if i > lo:
                offer(before[i])

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        text = "".join(chunks).replace(" ", SPACE)
        sizes = np.array([len(c) for c in chunks], np.int64)
        # a gap after each chunk, so that no piece is found across two of them
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        gapped = np.zeros(len(text) + len(chunks), np.int64)
        spot = np.arange(len(text)) + np.repeat(np.arange(len(chunks)), sizes)
        gapped[spot] = self._codes(text)
        table = self._edges(gapped).reshape(-1, self.longest - 1)[spot].ravel()
        starts = np.ones(len(text) + 1, bool)
        short = sizes <= LONG_CHUNK
        if short.any():
            mask = np.repeat(short, sizes)
            if mask.all():
                self._relax(table, bounds, starts)
            else:
                own = np.ones(int(mask.sum()) + 1, bool)
                self._relax(table.reshape(-1, self.longest - 1)[mask].ravel(), np.concatenate(([0], np.cumsum(sizes[short]))), own)
                starts[:-1][mask] = own[:-1]
        for k in np.flatnonzero(~short).tolist():
            self._relax_long(table, int(bounds[k]), int(bounds[k + 1]), starts)
        tokens = np.flatnonzero(starts[:-1])
        length = np.diff(np.append(tokens, len(text)))
        ids = np.zeros(len(tokens), np.int64)
        many = length > 1
        ids[many] = self.id_of_rank[table[tokens[many] * (self.longest - 1) + length[many] - 2]]
        lone = np.flatnonzero(~many)
        singles = [text[i] for i in tokens[lone].tolist()]
        spelled: list[tuple[int, list[int]]] = []
        for k, c in zip(lone.tolist(), singles, strict=True):
            got = self.single.get(c)
            if got is None:
                got = -1
                spelled.append((k, [self.bytes_of[b] for b in c.encode()] if self.bytes_of else [self.unknown]))
            ids[k] = got
        count = np.ones(len(tokens), np.int64)
        if spelled:
            count[[k for k, _ in spelled]] = [len(x) for _, x in spelled]
        flat = np.repeat(ids, count)
        at = np.concatenate(([0], np.cumsum(count)))
        for k, x in spelled:
            flat[at[k] : at[k + 1]] = x
        data = flat.astype("<u2").tobytes()
        cuts = (2 * at[np.searchsorted(tokens, bounds)]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        found = [self.chunks.get(c) for c in chunks]
        new = [c for c, f in zip(chunks, found, strict=True) if f is None]
        made, lo = [], 0
        while lo < len(new):
            hi, chars = lo, 0
            while hi < len(new) and (hi == lo or chars + len(new[hi]) <= BATCH_CHARS):
                chars += len(new[hi])
                hi += 1
            made += self._encode_chunks(new[lo:hi])
            lo = hi
        for c, x in zip(new, made, strict=True):
            if len(self.chunks) >= MOST:
                break
            if len(c) <= LONG_CHUNK:
                self.chunks[c] = x
        rest = iter(made)
        return [f if f is not None else next(rest) for f in found]

    def encode_texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts, in order: all ids, and the n + 1 places where the texts' ids begin. A null is empty."""
        data, offsets = kernel.texts_of(column)
        for lo, hi in kernel.slices(offsets, BATCH_BYTES):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            mark = np.flatnonzero(part == 0xE2)
            mark = mark[mark + 2 < len(part)]
            if ((part[mark + 1] == 0x96) & (part[mark + 2] == 0x81)).any():  # the sign for a space counts as a space
                texts = [part[a:b].tobytes().replace(SPACE.encode(), b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
                part, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            yield self._together(part, at)

    def _together(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][some], 32)  # each text that isn't empty gets a space in front
        offsets = offsets + np.concatenate(([0], np.cumsum(some)))
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        cut = (data == 10) | (data == 32)
        cut[1:] = (data[1:] == 10) | (data[:-1] == 10) | (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets[:-1][some]] = True
        places = np.append(np.flatnonzero(cut), len(data))
        strings = pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        coded = strings.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        size = np.array([len(x) for x in found], np.int64) // 2
        ids, at = np.frombuffer(b"".join(found), "<u2"), np.concatenate(([0], np.cumsum(size)))
        counts = size[code]
        stops = np.concatenate(([0], np.cumsum(counts)))
        out = ids[np.repeat(at[code] - stops[:-1], counts) + np.arange(stops[-1])]
        return out, stops[np.searchsorted(places, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids. The space in front of a text is dropped; broken UTF-8 becomes U+FFFD."""
        size = np.diff(self.spelled_at)[ids]
        stops = np.concatenate(([0], np.cumsum(size)))
        data = self.spelled[np.repeat(self.spelled_at[ids] - stops[:-1], size) + np.arange(stops[-1])].tobytes()
        cuts = stops[bounds].tolist()
        return [t[1:] if t[:1] == " " else t for t in (data[a:b].decode(errors="replace") for a, b in zip(cuts, cuts[1:], strict=False))]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec a model and worker process."""
    return PieceCodec(path)


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lo = 0
            for ids, bounds in own.encode_texts(batch.column(1)):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + n], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["id", "ids"])
                lo += n

    return encode


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                bounds = lists.offsets.to_numpy().astype(np.int64)
                texts = own.decode(lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return decode


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, however long.

    Null and empty texts have no ids; repeated rows stay, and equal texts have equal ids; an empty table gives no
    rows. Other columns of ``df``, whatever their names, aren't returned.
    """
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_encoder(path), "id long, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids; a null list is an empty text; repeated rows stay. An id outside the model fails the task."""
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{ids_col}`")).mapInArrow(_decoder(path), "id long, text string")


DIGEST_DDL = "id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _digester(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lo = 0
            for ids, bounds in own.encode_texts(batch.column(1)):
                n = len(bounds) - 1
                texts = batch.column(1)[lo : lo + n].to_pylist()
                wide, back = ids.astype("<u4"), own.decode(ids, bounds)
                sums = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo : lo + n], pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in back]), pa.array([a == (b or "") for a, b in zip(back, texts, strict=True)])],
                    names=["id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
                )
                lo += n

    return digest


def round_trips(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode(encode(df))`` gives, as digests, in one pass: (id, n_pieces, ids_crc32, decoded_sha256, round_trip).

    What ``encode`` says of nulls, repeated rows, long texts and other columns holds here, too.
    """
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_digester(path), DIGEST_DDL)
