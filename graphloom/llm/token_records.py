"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is: length of the payload (unsigned 64 bits), masked CRC-32 of these eight bytes, the payload,
masked CRC-32 of the payload; all little-endian. The mask rotates the checksum and adds a constant, so that
a checksum over data that hold checksums stays sound. The payload is a document's ids, two bytes each if the
vocabulary allows it and four otherwise. The index has one fixed-size entry a record, so that a shuffled
reader finds record k without reading those before it.

Files are written in ascending order of document by tasks that may be run again: every attempt writes files of
its own name and never touches another's, and the list of files names those of the attempts that counted. So
nothing is renamed or replaced, which not every store can do; files of lost attempts are on no list.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import store
from graphloom.llm.tokens import encoder

MASK = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8"), ("known", "u1")])
READ_ROWS = 2000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one begins; ValueError if it is damaged."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"damaged payload at byte {at}")
    return payload, end + 4


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _writer(tokenizer: str, end_id: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, place = _open(folder)
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        files.create_dir(place)
        records = ids = at = 0
        entries: list[tuple] = []
        with files.open_output_stream(f"{place}/{name}.rec") as out, files.open_output_stream(f"{place}/{name}.idx") as index:
            for batch in batches:
                docs = iter(batch.column(0).to_pylist())
                for tokens, bounds in enc.encode_texts(batch.column(1)):
                    for k, doc in zip(range(len(bounds) - 1), docs):
                        payload = tokens[bounds[k] : bounds[k + 1]].tobytes() + end
                        out.write(frame(payload))
                        n = len(payload) // enc.dtype.itemsize
                        entries.append((0 if doc is None else doc, at, n, doc is not None))
                        at, records, ids = at + len(payload) + 16, records + 1, ids + n
                index.write(np.array(entries, INDEX).tobytes())
                entries.clear()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "records": [records], "ids": [ids], "bytes": [at], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    return write


FILES_DDL = "part int, file string, records long, ids long, bytes long, width int"
ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_records(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes the record files and indexes; returns the files.

    Rows go in ascending order of id, nulls first; rows of one id by a hash of their text, then the text, so that
    many of them needn't lie in one file. A null text is empty. An empty table gives files without records, or
    none. Other columns, whatever their names, are left out. ``folder`` must be reached by all executors.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    made = ranged.mapInArrow(_writer(tokenizer, end_id, folder), FILES_DDL).collect()  # one short row a file
    spark = df.sparkSession
    return spark.createDataFrame(sorted(made, key=lambda r: r.part), FILES_DDL)


def _records(files: pafs.FileSystem, place: str, most: int = 8 << 20) -> Iterator[bytes]:
    """The payloads of a file, read in blocks."""
    with files.open_input_stream(f"{place}.rec") as src:
        data, at = b"", 0
        while True:
            need = 12 if len(data) - at < 12 else 16 + struct.unpack_from("<Q", data, at)[0]
            if len(data) - at < need:
                more = src.read(max(most, need))
                if not more:
                    if len(data) > at:
                        raise ValueError(f"{place}: the last record is cut short")
                    return
                data, at = data[at:] + more, 0
                continue
            payload, at = unframe(data, at)
            yield payload


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for job in batch.to_pylist():
            files, place = _open(job["file"])
            kind = np.dtype("<u2" if job["width"] == 2 else "<u4")
            with files.open_input_stream(f"{place}.idx") as src:
                index = np.frombuffer(src.read(), INDEX)
            if len(index) != job["records"]:
                raise ValueError(f"{place}: {len(index)} index entries for {job['records']} records")
            starts = job["base"] + np.concatenate(([0], np.cumsum(index["n_tokens"])))[:-1]
            out: list[tuple] = []
            for k, payload in enumerate(_records(files, place)):
                ids = np.frombuffer(payload, kind)
                if len(ids) != index["n_tokens"][k]:
                    raise ValueError(f"{place}: record {k} and its index entry differ")
                out.append((int(index["doc_id"][k]) if index["known"][k] else None, int(starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(out) == READ_ROWS:
                    yield _rows(out)
                    out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record of the files that ``write_records`` returned.

    Checksums and index entries are verified. start counts the ids of all records before.
    """
    listed, base, jobs = files.orderBy("part").collect(), 0, []  # one short row a file
    for f in listed:
        jobs.append((f.file, f.records, f.width, base))
        base += f.ids
    jobs = [j for j in jobs if j[1]]
    table = spark.createDataFrame(jobs, "file string, records long, width int, base long")
    return table.coalesce(1).repartition(max(1, len(jobs))).mapInArrow(_reader, ROWS_DDL)  # a file a task


def read_at(file: str, width: int, which: list[int]) -> Iterator[np.ndarray]:
    """The ids of records ``which``, in that order, found through the index: a shuffled read."""
    files, place = _open(file)
    with files.open_input_stream(f"{place}.idx") as src:
        index = np.frombuffer(src.read(), INDEX)
    with files.open_input_file(f"{place}.rec") as src:
        for k in which:
            src.seek(int(index["offset"][k]))
            yield np.frombuffer(unframe(src.read(int(index["n_tokens"][k]) * width + 16))[0], np.dtype("<u2" if width == 2 else "<u4"))


def token_records(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the records to the shared folder and returns what reading them back gives."""
    spark = df.sparkSession
    folder = store.new_dir(spark, "token-records")
    return read_records(spark, write_records(df, folder, tokenizer, end_id))
