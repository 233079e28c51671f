"""Data source ``scan_payload``: inventories as compact binary files, one or more a partition, read back in ranges of rows.

A file is a header (magic, version, number of rows, bytes of the table and of the heap), rows of 56 bytes, and a heap of UTF-16 names and paths
whose absolute offsets stand in the rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from inodeon.model import SCAN_RECORDS
from inodeon.sources import files, ntfs

# Fixed values of the format.
MAGIC, VERSION = 0x4D4C5343, 1
HEADER, ROW = struct.Struct("<IiiQQ"), struct.Struct("<QQQqIIiiii")
FIELDS = np.dtype([("record", "<u8"), ("parent", "<u8"), ("size", "<u8"), ("ticks", "<i8"), ("attributes", "<u4"), ("directory", "<u4"), ("name_at", "<i4"), ("name", "<i4"), ("path_at", "<i4"), ("path", "<i4")])
LIMIT = 2**31 - 1
#: Bytes at which a file ends, well below the format's limit, since a task holds a file; rows of a file that are looked at and read at once.
FILE_BYTES = 64 << 20
BATCH_ROWS = 1 << 13
SLICE_ROWS = 1 << 16
_SCHEMA = pa.schema([("record_number", pa.int64()), ("parent_record_number", pa.int64()), ("size", pa.decimal128(20, 0)), ("last_write_ticks", pa.int64()), ("attributes", pa.int64()), ("is_directory", pa.bool_()), ("name", pa.string()), ("path", pa.string())])


def heap_of(names: pa.Array, paths: pa.Array) -> tuple[bytes, np.ndarray]:
    """Both columns' texts as UTF-16, each row's name and then its path, and the ends of all of them in bytes; nulls are empty."""
    n = len(names)
    both = pa.concat_arrays([c.cast(pa.large_string()) for c in (names, paths)])
    heap, ends = ntfs.units_of(both.take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel())))
    return heap, 2 * ends


def encode(batches: list[pa.RecordBatch]) -> bytes:
    """Rows of the payload's columns as one file."""
    return b"".join(_file([_piece(b) for b in batches]))


def _file(pieces: list[tuple[np.ndarray, bytes]]) -> Iterator[bytes]:
    """A file of pieces, one after another: the header, all tables, whose offsets begin to count at the file's start now, and all heaps."""
    n, size = sum(len(table) for table, _ in pieces), sum(len(heap) for _, heap in pieces)
    base = HEADER.size + ROW.size * n
    if base + size > LIMIT:
        raise ValueError("a scan payload can't be larger than 2 GiB; write smaller batches")
    yield HEADER.pack(MAGIC, VERSION, n, ROW.size * n, size)
    for table, heap in pieces:
        placed = table.copy()
        for field in ("name_at", "path_at"):
            placed[field] += base
        base += len(heap)
        yield placed.tobytes()
    yield from (heap for _, heap in pieces)


def _piece(rows: pa.RecordBatch) -> tuple[np.ndarray, bytes]:
    """A batch's table, with offsets from the start of its heap, and the heap."""
    column = rows.column
    heap, ends = heap_of(column("name"), column("path"))
    table = np.zeros(rows.num_rows, dtype=FIELDS)
    numbers = {"record": "record_number", "parent": "parent_record_number", "ticks": "last_write_ticks", "attributes": "attributes"}
    for field, name in numbers.items():
        table[field] = pc.fill_null(column(name), 0).to_numpy(zero_copy_only=False)
    table["size"] = pc.fill_null(column("size"), 0).cast(pa.uint64()).to_numpy(zero_copy_only=False)
    table["directory"] = pc.fill_null(column("is_directory"), False).to_numpy(zero_copy_only=False)
    sizes = np.diff(np.r_[0, ends])
    for k, field in enumerate(("name", "path")):
        table[f"{field}_at"] = ends[k::2] - sizes[k::2]
        table[field] = sizes[k::2]
    return table, heap


def _texts(heap: bytes, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Texts of so many bytes at places of the heap; what lies beyond its end is cut off."""
    units = np.clip(np.minimum(size, len(heap) - at), 0, None) // 2
    place = np.repeat(at - 2 * (np.cumsum(units) - units), units) + 2 * np.arange(int(units.sum()))
    data = np.frombuffer(heap, dtype=np.uint8)
    return ntfs.strings(data[place] | data[place + 1].astype(np.uint16) << np.uint16(8), units)


def row_count(path: str) -> int:
    magic, _, count, _, _ = HEADER.unpack(files.read_range(path, 0, HEADER.size))
    if magic != MAGIC:
        raise ValueError(f"{path} is not a scan payload")
    return count


def decode(path: str, first: int, count: int) -> pa.RecordBatch:
    """Rows of a file; only they and the part of the heap with their texts are read."""
    rows = np.frombuffer(files.read_range(path, HEADER.size + first * ROW.size, count * ROW.size), dtype=FIELDS)
    at = np.concatenate([rows["name_at"], rows["path_at"]]).astype(np.int64)
    end = at + np.concatenate([rows["name"], rows["path"]])
    low = int(at.min()) if count else 0
    heap = files.read_range(path, low, int(end.max()) - low) if count else b""
    columns = [
        pa.array(rows["record"].astype(np.int64)),
        pa.array(rows["parent"].astype(np.int64)),
        pa.array(rows["size"].astype(np.uint64)).cast(pa.decimal128(20, 0)),
        pa.array(rows["ticks"].astype(np.int64)),
        pa.array(rows["attributes"].astype(np.int64)),
        pa.array(rows["directory"] != 0),
        _texts(heap, rows["name_at"].astype(np.int64) - low, rows["name"].astype(np.int64)),
        _texts(heap, rows["path_at"].astype(np.int64) - low, rows["path"].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_payload"

    def schema(self) -> str:
        return SCAN_RECORDS

    def reader(self, schema: object) -> DataSourceReader:
        return PayloadReader(self.options["path"])

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return PayloadWriter(self.options["path"])


class PayloadReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[Slice]:
        found = [f"{self.path}/{n}" for n in files.names(self.path, ".scan")]
        return [Slice(p, at, min(SLICE_ROWS, n - at)) for p in found for n in [row_count(p)] for at in range(0, n, SLICE_ROWS)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.count, BATCH_ROWS):
            yield decode(part.path, part.first + at, min(BATCH_ROWS, part.count - at))


class PayloadWriter(DataSourceArrowWriter):
    """Tasks write under temporary names; only a committed job's files get their own.

    Batches are encoded as they come, so that a task holds a file's bytes and no more. A file ends with the batch that brings it to ``FILE_BYTES``, by rows
    and by twice the UTF-8 bytes of its texts, which UTF-16 doesn't exceed.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        paths: list[str] = []
        held: list[tuple[np.ndarray, bytes]] = []
        size = 0

        def put() -> None:
            paths.append(f"{self.path}/{uuid.uuid4().hex}.scan.tmp")
            with files.create(paths[-1]) as out:
                for raw in _file(held):
                    out.write(raw)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = sum(pc.sum(pc.binary_length(part.column(c))).as_py() or 0 for c in ("name", "path"))
                held.append(_piece(pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in _SCHEMA], schema=_SCHEMA)))
                size += ROW.size * part.num_rows + 2 * texts
                if size >= FILE_BYTES:
                    put()
                    size = 0
        if held or not paths:
            put()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        for path in (p for m in messages if m for p in m.paths):
            files.rename(path, path.removesuffix(".tmp"))

    def abort(self, messages: list[Written | None]) -> None:
        for path in (p for m in messages if m for p in m.paths):
            files.delete(path)


def write(scan: DataFrame, path: str) -> None:
    scan.sparkSession.dataSource.register(PayloadSource)
    columns = [c.split()[0] for c in SCAN_RECORDS.split(", ")]
    scan.select(*columns).write.format("scan_payload").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PayloadSource)
    return spark.read.format("scan_payload").option("path", path).load()
