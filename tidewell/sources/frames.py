"""Binary logs and segment files as Spark data sources ("wal" and "segment").

A log frame is magic, key length, key, value length, value, ts, op and a CRC-32 of all before it; a segment record is
key length, key, value length, value, ts, in key order. Fields are little-endian, lengths and ts 8 bytes. A file is
never split; a task that writes a log starts a new file after LOG_BYTES (option `fileBytes`), a segment is one file. Reading a log stops quietly at a truncated last frame and raises at a bad magic or CRC (option
`permissive`: stops there too). Files are read through Spark's binaryFile source; a path to write to names its file
system (file, hdfs, s3, gs), a plain path is a folder that driver and executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MAGIC = b"TWLG"
SCHEMA = "seq BIGINT, key BINARY, value BINARY, ts BIGINT, op STRING"
#: A log file ends with the first frame that makes it longer.
LOG_BYTES = 64_000_000
#: Rows, and bytes of keys and values, that a batch of decoded frames is sent on with.
BATCH_ROWS, BATCH_BYTES = 8192, 8_000_000
_U64 = struct.Struct("<Q")


def encode_frame(key: bytes, value: bytes | None, ts: int, op: str) -> bytes:
    data = value or b""
    body = MAGIC + _U64.pack(len(key)) + key + _U64.pack(len(data)) + data + _U64.pack(ts) + bytes([op == "DELETE"])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frames(data: bytes | bytearray | memoryview, permissive: bool = False) -> Iterator[tuple[int, bytes, bytes | None, int, str]]:
    """(seq, key, value, ts, op) of each whole frame, in the order written; the op alone says what is deleted."""
    at, seq = 0, 0
    while True:
        ends, p = [], at + 4
        for _ in range(2):
            if p + 8 > len(data):
                return
            n = _U64.unpack_from(data, p)[0]
            if data[at : at + 4] != MAGIC:
                if permissive:
                    return
                raise ValueError(f"bad magic at byte {at}")
            ends.append((p + 8, p + 8 + n))
            p += 8 + n
        if p + 13 > len(data):
            return
        if zlib.crc32(data[at : p + 9]) != struct.unpack_from("<I", data, p + 9)[0]:
            if permissive:
                return
            raise ValueError(f"CRC mismatch in the frame at byte {at}")
        seq += 1
        deleted = data[p + 8] == 1
        yield seq, bytes(data[slice(*ends[0])]), None if deleted else bytes(data[slice(*ends[1])]), _U64.unpack_from(data, p)[0], "DELETE" if deleted else "PUT"
        at = p + 13


def encode_record(key: bytes, value: bytes | None, ts: int) -> bytes:
    data = value or b""
    return _U64.pack(len(key)) + key + _U64.pack(len(data)) + data + _U64.pack(ts)


def decode_records(data: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    at = 0
    while at < len(data):
        n = _U64.unpack_from(data, at)[0]
        key, at = data[at + 8 : at + 8 + n], at + 8 + n
        n = _U64.unpack_from(data, at)[0]
        value, at = data[at + 8 : at + 8 + n], at + 8 + n
        yield key, value, _U64.unpack_from(data, at)[0]
        at += 8


def _some(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """rows (seq, key, value, ts, op) in lists of bounded length and size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1]) + len(r[2] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_log(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Frames of every log file under a path: (seq, key, value, ts, op, file); seq counts within a file."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with memoryview(content.as_buffer()) as data:
                    for rows in _some(decode_frames(data, permissive)):
                        cols = [*zip(*rows), [name] * len(rows)]
                        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["seq", "key", "value", "ts", "op", "file"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA + ", file STRING")


def read_segment(spark: SparkSession, path: str) -> DataFrame:
    """Records of segment files: (key, value, ts), half-open ranges by an ordinary filter."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = list(decode_records(content.as_buffer().to_pybytes()))
                cols = list(zip(*rows)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64()))], ["key", "value", "ts"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key BINARY, value BINARY, ts BIGINT")


@dataclass
class _Wrote(WriterCommitMessage):
    paths: list[str]


class _FrameWriter(DataSourceWriter):
    """Files of a task under hidden names, shown on commit: one, or of a log one per file_bytes."""

    def __init__(self, path: str, segment: bool, file_bytes: int = LOG_BYTES):
        self.path, self.segment, self.file_bytes = path, segment, file_bytes

    def _folder(self) -> tuple[FileSystem, str]:
        uri = self.path if "://" in self.path else "file://" + os.path.abspath(self.path.removeprefix("file:"))
        return FileSystem.from_uri(uri)

    def write(self, rows) -> _Wrote:
        files, folder = self._folder()
        files.create_dir(folder, recursive=True)
        hidden, last, more = [], None, True
        rows = iter(rows)
        while more:
            hidden.append(f"{folder}/.{uuid.uuid4().hex}")
            size, more = 0, False
            with files.open_output_stream(hidden[-1]) as out:
                for r in rows:
                    key = bytes(r["key"])
                    value = None if r["value"] is None else bytes(r["value"])
                    if self.segment:
                        if last is not None and key <= last:
                            raise ValueError("a segment's keys must increase")
                        last = key
                        out.write(encode_record(key, value, r["ts"]))
                    else:
                        size += out.write(encode_frame(key, value, r["ts"], r["op"]))
                        if size >= self.file_bytes:
                            more = True
                            break
            if isinstance(files, LocalFileSystem):  # others are durable once closed
                with open(hidden[-1], "rb") as written:
                    os.fsync(written.fileno())
        return _Wrote(hidden)

    def commit(self, messages) -> None:
        files, folder = self._folder()
        for k, hidden in enumerate(p for m in messages if m for p in m.paths):
            files.move(hidden, f"{folder}/part-{k:05d}-{os.path.basename(hidden)[1:9]}.bin")

    def abort(self, messages) -> None:
        files, _ = self._folder()
        for hidden in (p for m in messages if m for p in m.paths):
            if files.get_file_info(hidden).type != FileType.NotFound:
                files.delete_file(hidden)


class LogSource(DataSource):
    """`df.write.format("wal").mode("append").save(path)` of (key, value, ts, op)."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool):
        return _FrameWriter(self.options["path"], False, int(self.options.get("fileBytes", LOG_BYTES)))


class SegmentSource(DataSource):
    """`df.write.format("segment").mode("append").save(path)` of (key, value, ts) sorted by key within partitions."""

    @classmethod
    def name(cls) -> str:
        return "segment"

    def schema(self) -> str:
        return "key BINARY, value BINARY, ts BIGINT"

    def writer(self, schema, overwrite: bool):
        return _FrameWriter(self.options["path"], True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
    spark.dataSource.register(SegmentSource)
