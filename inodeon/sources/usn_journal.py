"""Data source ``usn_journal``: change journals kept as segment files, read in batches and as a stream.

A segment file ``<journal id>-<first usn>.usn`` holds what one read of a journal returns: the next USN, then version-2
change records. Options: ``path`` (folder), ``drive``, ``startingUsn``, ``startingOffset`` earliest or latest, ``rangeBytes``, and for streams
``maxUsnPerBatch`` with ``position``. A stream's offset is the cursor (journal id, next USN). A journal that was created anew, or whose entries
after the cursor are gone, fails the query.

Data source ``usn_drives``: the same for many drives in one query, ``drives`` being JSON by drive of path, journal_id and next_usn. Its offset holds every
drive's cursor, and what fails on one drive is a row with an ``error`` instead of an exception; that drive then stands still, the others go on.

**Ranges.** A segment is read in ranges of bytes by different tasks. Records can only be told by following lengths from the segment's start, so a task
follows the lengths from every place before its range where a record could begin, as far back as the longest record reaches. Those chains run into
each other or into something that is no record; the true one is always among them, so once all that are left enter the range at one place, that is
where its first record begins. While they don't, the task begins further back, at last at the segment's start. Each range has a task of its own as long as they
are few; beyond that neighbouring ranges, and small segments, are read by one task in one go, so that the number of tasks doesn't grow with that of ranges.

**Bounded batches.** A source isn't told where its query stands when it is asked for the latest offset, so a limited stream keeps its place in the
file ``position``, written before a batch is read. With the trigger ``availableNow`` Spark asks once only, for one batch; ``drain`` reads all in bounded ones.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from inodeon.model import REFERENCE_MASK, USN_ENTRIES, JournalDeleting, JournalError, JournalNotActive, JournalWrapped
from inodeon.sources import files, ntfs

HEADER = 60
MAX_NAME = 259
BATCH = 8192
#: Bytes of a range.
RANGE_BYTES = 16 << 20
#: No record is longer, as the length of its name has 16 bits.
MAX_RECORD = 1 << 17
#: How far before a range chains begin at first: far enough to hold the beginning of a record.
LOOK_BACK = MAX_RECORD
#: Drives whose journals are looked up at once.
LISTINGS = 16
#: Bytes of small slices that one task of a stream over many drives reads at least.
PACK_BYTES = 1 << 20
#: Ranges beyond so many are read by a task together, RANGE_BYTES at most.
TASKS = 36
_SCHEMA = pa.schema(
    [("drive", pa.string()), ("journal_id", pa.decimal128(20, 0))]
    + [(c, pa.int64()) for c in ("record_number", "parent_record_number", "usn", "filetime", "reason", "file_attributes")]
    + [("file_name", pa.string())]
)
_DRIVES_SCHEMA = _SCHEMA.append(pa.field("error", pa.string()))


#: The fixed part of a record, in the format's order.
RECORD = np.dtype([("length", "<u4"), ("major", "<u2"), ("minor", "<u2"), ("record", "<u8"), ("parent", "<u8"), ("usn", "<i8"), ("filetime", "<i8"), ("reason", "<u4"), ("source", "<u4"), ("security", "<u4"), ("attributes", "<u4"), ("name", "<u2"), ("name_at", "<u2")])
_ENTRY = ("record_number", "parent_record_number", "usn", "filetime", "reason", "file_attributes", "file_name")


def encode_columns(next_usn: int, entries: pa.Table) -> bytes:
    """A read buffer of the entries' columns, in their order."""
    names, ends = ntfs.units_of(entries.column("file_name").combine_chunks() if entries.num_rows else pa.array([], pa.string()))
    sizes = 2 * np.diff(np.r_[0, ends])
    fixed = np.zeros(entries.num_rows, dtype=RECORD)
    lengths = (HEADER + sizes + 7) // 8 * 8
    fixed["length"], fixed["major"], fixed["name"], fixed["name_at"] = lengths, 2, sizes, HEADER
    for field, name in zip(("record", "parent", "usn", "filetime", "reason", "attributes"), _ENTRY):
        fixed[field] = entries.column(name).to_numpy()
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), dtype=np.uint8)
    out[(starts[:, None] + np.arange(HEADER)).ravel()] = fixed.view(np.uint8)
    place = np.repeat(starts + HEADER - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[place] = np.frombuffer(names, dtype=np.uint8)
    return struct.pack("<q", next_usn) + out.tobytes()


def encode_buffer(next_usn: int, entries: list[tuple[int, int, int, int, int, int, str]]) -> bytes:
    """A read buffer of ``(record, parent, usn, filetime, reason, attributes, name)`` entries."""
    columns = list(zip(*entries)) if entries else [()] * len(_ENTRY)
    kinds = (pa.uint64(), pa.uint64(), *[pa.int64()] * 4, pa.string())
    return encode_columns(next_usn, pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], list(_ENTRY)))


def _places(raw: bytes, at: int, stop: int) -> list[int]:
    """Where the records that begin before ``stop`` are; ends at a short tail or a record of no length."""
    places, size = [], len(raw)
    length_at = struct.Struct("<I").unpack_from
    while at < stop and at + HEADER <= size:
        (length,) = length_at(raw, at)
        if length == 0 or at + length > size:
            break
        places.append(at)
        at += length
    return places


def decode_columns(raw: bytes, at: int = 8, stop: int | None = None) -> dict[str, np.ndarray | pa.Array]:
    """The entries of a buffer as columns, from the record at ``at`` on; stops at a short tail or a record of no length.

    Only the records' lengths are followed one by one; fields and names are taken from all at once.
    """
    size = len(raw)
    data = np.frombuffer(raw, dtype=np.uint8)
    start = np.array(_places(raw, at, size if stop is None else stop), dtype=np.int64)

    def field(offset: int, width: int) -> np.ndarray:
        out = np.zeros(len(start), dtype=np.uint64)
        for i in range(width):
            out |= data[start + offset + i].astype(np.uint64) << np.uint64(8 * i)
        return out.view(np.int64)

    start = start[field(4, 2) == 2]
    begin = start + field(58, 2)
    units = np.minimum(np.minimum(field(56, 2), 2 * MAX_NAME), np.maximum(size - begin, 0)) // 2
    before = np.cumsum(units) - units
    place = np.repeat(begin - 2 * before, units) + 2 * np.arange(int(units.sum()))
    return {
        "record_number": field(8, 8) & REFERENCE_MASK,
        "parent_record_number": field(16, 8) & REFERENCE_MASK,
        "usn": field(24, 8),
        "filetime": field(32, 8),
        "reason": field(40, 4),
        "file_attributes": field(52, 4),
        "file_name": ntfs.strings(data[place] | data[place + 1].astype(np.uint16) << np.uint16(8), units),
    }


def entries_into(raw: bytes, lo: int, aligned: int) -> set[int]:
    """Where chains of records that begin before ``lo`` and don't break go on at or after it; all offsets are those of ``raw``.

    Chains begin at every eighth byte from ``aligned`` on. Those that meet are followed once.
    """
    lengths = np.frombuffer(raw, "<u4", (len(raw) - aligned) // 4, aligned)[::2] if len(raw) - aligned >= 8 else np.empty(0, np.uint32)
    steps = lengths.astype(np.int64)
    fits = (steps >= HEADER) & (steps < MAX_RECORD) & (steps % 8 == 0)
    end = (lo - aligned) // 8
    # each place's way out, from the last one back: a longer way is known when its next place is
    leaves = np.full(end, -1, dtype=np.int64)
    for k in range(end - 1, -1, -1):
        if fits[k]:
            to = k + int(steps[k]) // 8
            leaves[k] = aligned + 8 * to if to >= end else leaves[to]
    return set(leaves[leaves >= 0].tolist())


def decode_buffer(raw: bytes) -> tuple[int | None, list[tuple[int, int, int, int, int, int, str]]]:
    """The next USN and the entries of a buffer."""
    if len(raw) < 8:
        return None, []
    return struct.unpack_from("<q", raw)[0], list(zip(*(c.tolist() if isinstance(c, np.ndarray) else c.to_pylist() for c in decode_columns(raw).values())))


@dataclass(frozen=True)
class Segment:
    path: str
    journal_id: int
    first: int
    size: int


def segments(folder: str) -> list[Segment]:
    """Segments in USN order, those of the newest journal; a file ``<journal id>.deleting`` says that the journal is being deleted."""
    if files.names(folder, ".deleting"):
        raise JournalDeleting(f"{folder}: the journal is being deleted")
    found = []
    for name, size in files.sizes(folder, ".usn"):
        journal, _, first = name.removesuffix(".usn").partition("-")
        found.append(Segment(f"{folder.rstrip('/')}/{name}", int(journal), int(first), size))
    newest = max((s.journal_id for s in found), default=0)
    return sorted((s for s in found if s.journal_id == newest), key=lambda s: s.first)


def _next_usn(segment: Segment) -> int:
    raw = files.read_range(segment.path, 0, 8)
    if len(raw) < 8:
        raise JournalError(f"{segment.path} is cut off")
    return struct.unpack("<q", raw)[0]


def query_cursor(folder: str) -> tuple[int, int]:
    """The cursor (journal id, next USN) behind the last entry."""
    known = segments(folder)
    if not known:
        raise JournalNotActive(f"{folder} has no journal")
    return known[-1].journal_id, _next_usn(known[-1])


def append_segment(folder: str, journal_id: int, first: int, next_usn: int, entries: list | pa.Table) -> str:
    """A new segment of entries or their columns; it appears whole, under a name that shows its place, also if several tasks write it."""
    path = f"{folder.rstrip('/')}/{journal_id:020d}-{first:020d}.usn"
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.create(own) as out:
        out.write(encode_columns(next_usn, entries) if isinstance(entries, pa.Table) else encode_buffer(next_usn, entries))
    files.rename(own, path)
    return path


def _checked(folder: str, known: list[Segment], journal_id: int, start: int) -> None:
    """Raises what keeps a cursor from being gone on with."""
    if journal_id and known[0].journal_id != journal_id:
        raise JournalError(f"{folder}: the journal was created anew ({known[0].journal_id} instead of {journal_id}); a full rescan is needed")
    if start and start < known[0].first:
        raise JournalWrapped(f"{folder}: entries from {start} to {known[0].first} are gone; a full rescan is needed")


def bounded_end(known: list[Segment], start: int, max_usn: int) -> int:
    """The end of what may be read from ``start`` on: the journal's end, or ``max_usn`` further; a longer gap between segments counts nothing."""
    end = _next_usn(known[-1])
    if not max_usn or start >= end:
        return end
    at = max(start, known[0].first)
    later = [s.first for s in known if s.first > at]
    if later and later[0] >= at + max_usn:
        own = [s for s in known if s.first <= at][-1]
        at = later[0] if _next_usn(own) <= at else at
    return min(end, at + max_usn)


@dataclass
class SegmentSlice(InputPartition):
    drive: str
    path: str
    journal_id: int
    start: int
    end: int
    lo: int = 0
    hi: int = 0
    error: str = ""


@dataclass
class SliceGroup(InputPartition):
    """Small slices that one task reads."""

    parts: list[SegmentSlice]


def packed(slices: list[SegmentSlice], size: int) -> list[SliceGroup]:
    """The slices in groups of about so many bytes at most."""
    groups: list[SliceGroup] = []
    room = 0
    for part in slices:
        need = part.hi - part.lo + 4096  # what opening a file costs, in bytes
        if need > room:
            groups.append(SliceGroup([]))
            room = size
        groups[-1].parts.append(part)
        room -= need
    return groups


def dealt(slices: list[SegmentSlice], least: int = 0) -> list[SliceGroup]:
    """The slices in groups of at least so many bytes, about ``TASKS`` groups if none gets larger than ``RANGE_BYTES``; neighbours of a segment become one slice."""
    total = sum(part.hi - part.lo + 4096 for part in slices)
    groups = packed(slices, max(least, min(RANGE_BYTES, total // TASKS)))
    for group in groups:
        merged: list[SegmentSlice] = []
        for part in group.parts:
            if merged and not part.error and (merged[-1].path, merged[-1].hi) == (part.path, part.lo):
                merged[-1] = replace(merged[-1], hi=part.hi)
            else:
                merged.append(part)
        group.parts = merged
    return groups


class UsnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usn_journal"

    def schema(self) -> str:
        return USN_ENTRIES

    def reader(self, schema: object) -> DataSourceReader:
        return UsnReader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return UsnStreamReader(dict(self.options))


class UsnDrivesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usn_drives"

    def schema(self) -> str:
        return f"{USN_ENTRIES}, error string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return UsnDrivesReader(dict(self.options))


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.path = get("path") or ""
        self.drive = get("drive", "")
        self.start = int(get("startingusn", "0"))
        self.journal = int(get("journalid", "0"))
        self.from_latest = get("startingoffset", "earliest") == "latest"
        self.range_bytes = max(8, int(get("rangebytes", str(RANGE_BYTES))) // 8 * 8)  # records begin at every eighth byte at most
        self.max_usn = int(get("maxusnperbatch", "0"))
        self.position = get("position") or ""
        self.drives: dict[str, dict] = json.loads(get("drives") or "{}")

    def slices(self, drive: str, folder: str, journal_id: int, start: int, end: int) -> list[SegmentSlice]:
        known = segments(folder)
        if not known or start >= end:
            return []
        _checked(folder, known, journal_id, start)
        after = [s.first for s in known[1:]] + [1 << 63]
        return [
            SegmentSlice(drive, s.path, s.journal_id, start, end, lo, min(lo + self.range_bytes, s.size))
            for s, nxt in zip(known, after)
            if s.first < end and nxt > start
            for lo in range(8, max(s.size, 9), self.range_bytes)
        ]

    def read(self, group: SliceGroup) -> Iterator[pa.RecordBatch]:
        for part in group.parts:
            yield from self.read_slice(part)

    def read_slice(self, part: SegmentSlice) -> Iterator[pa.RecordBatch]:
        raw, at, stop = _range(part)
        while True:
            # as many records at once as fit in a part of the range
            places = _places(raw, at, min(stop, at + (1 << 20)))
            if not places:
                return
            found = decode_columns(raw, at, places[-1] + 1)
            at = places[-1] + struct.unpack_from("<I", raw, places[-1])[0]
            inside = np.flatnonzero((found["usn"] >= part.start) & (found["usn"] < part.end))
            for k in range(0, len(inside), BATCH):
                own = inside[k : k + BATCH]
                n = len(own)
                fixed = [pa.repeat(pa.scalar(part.drive, pa.string()), n), pa.repeat(pa.scalar(Decimal(part.journal_id), pa.decimal128(20, 0)), n)]
                columns = [c.take(pa.array(own)) if isinstance(c, pa.Array) else pa.array(c[own]) for c in found.values()]
                yield pa.RecordBatch.from_arrays([*fixed, *columns], schema=_SCHEMA)


def _range(part: SegmentSlice) -> tuple[bytes, int, int]:
    """Bytes of a segment that hold a range's records whole, where the first of them begins, and where the range ends."""
    back = LOOK_BACK
    while part.lo > 8:
        first = max(8, part.lo - back)
        raw = files.read_range(part.path, first, part.lo + MAX_RECORD - first)
        if first == 8:
            chain = _places(raw, 0, part.lo - 8)
            into = {chain[-1] + struct.unpack_from("<I", raw, chain[-1])[0]} if chain else set()
            into = {x for x in into if first + x >= part.lo}
        else:
            into = entries_into(raw, part.lo - first, 0)
        if len(into) <= 1 or first == 8:
            begin = first + into.pop() if into else part.hi
            break
        back *= 4
    else:
        begin = part.lo
    if begin >= part.hi:
        return b"", 0, 0
    return files.read_range(part.path, begin, part.hi + MAX_RECORD - begin), 0, part.hi - begin


class UsnReader(_Reading, DataSourceReader):
    def partitions(self) -> list[SliceGroup]:
        return dealt(self.slices(self.drive, self.path, self.journal, self.start, 1 << 62))


class _Limited(_Reading, DataSourceStreamReader):
    """Streams that may be told how much to read at once, and then keep their place themselves."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self._at: Any = None
        if self.max_usn and not self.position:
            raise ValueError("maxUsnPerBatch needs a file for the position")

    def known_position(self) -> Any:
        """Where the last batch that was planned ends, if there was one."""
        if self._at is None and self.position and files.exists(self.position):
            self._at = json.loads(files.read_range(self.position, 0, files.size(self.position)))
        return self._at

    def planned(self, end: Any) -> None:
        self._at = end
        if self.position:
            own = f"{self.position}.{uuid.uuid4().hex}.tmp"
            with files.create(own) as out:
                out.write(json.dumps(end).encode())
            files.rename(own, self.position)

    def commit(self, end: dict) -> None:
        pass


class UsnStreamReader(_Limited):
    def initialOffset(self) -> dict:
        if self.from_latest:
            journal, usn = query_cursor(self.path)
            return {"journal_id": str(journal), "next_usn": usn}
        return {"journal_id": str(self.journal), "next_usn": self.start}

    def latestOffset(self) -> dict:
        known = segments(self.path)
        if not known:
            return self.known_position() or {"journal_id": str(self.journal), "next_usn": self.start}
        start = (self.known_position() or self.initialOffset())["next_usn"] if self.max_usn else 0
        return {"journal_id": str(known[-1].journal_id), "next_usn": bounded_end(known, start, self.max_usn)}

    def partitions(self, start: dict, end: dict) -> list[SliceGroup]:
        if int(start["journal_id"]) and start["journal_id"] != end["journal_id"]:
            raise JournalError(f"{self.path}: the journal was created anew ({end['journal_id']} instead of {start['journal_id']}); a full rescan is needed")
        found = self.slices(self.drive, self.path, int(end["journal_id"]), start["next_usn"], end["next_usn"])
        self.planned(end)
        return dealt(found)


class UsnDrivesReader(_Limited):
    """One stream of all drives; ``{drive: [journal id, next USN, error]}`` is its offset."""

    def initialOffset(self) -> dict:
        return {k: [str(d["journal_id"]), d["next_usn"], None] for k, d in self.drives.items()}

    def latestOffset(self) -> dict:
        at = self.known_position() or self.initialOffset()
        with ThreadPoolExecutor(LISTINGS) as pool:
            return dict(zip(self.drives, pool.map(lambda k: self._advanced(k, *at[k]), self.drives)))

    def _advanced(self, drive: str, journal: str, usn: int, error: str | None) -> list:
        if error:
            return [journal, usn, error]
        folder = self.drives[drive]["path"]
        try:
            known = segments(folder)
            if not known:
                raise JournalNotActive(f"{folder} has no journal")
            _checked(folder, known, int(journal), usn)
            return [str(known[-1].journal_id), max(usn, bounded_end(known, usn, self.max_usn)), None]
        except (JournalError, OSError) as e:
            return [journal, usn, f"{type(e).__name__}: {e}"]

    def partitions(self, start: dict, end: dict) -> list[SliceGroup]:
        found: list[SegmentSlice] = []
        for drive, (journal, usn, error) in end.items():
            begin = start[drive]
            if error and not begin[2]:
                found.append(SegmentSlice(drive, "", 0, 0, 0, error=error))
            elif not error and usn > begin[1]:
                try:
                    found += self.slices(drive, self.drives[drive]["path"], int(journal), begin[1], usn)
                except (JournalError, OSError) as e:  # gone since the offset was taken
                    found.append(SegmentSlice(drive, "", 0, 0, 0, error=f"{type(e).__name__}: {e}"))
        self.planned(end)
        return dealt(found, PACK_BYTES)

    def read_slice(self, part: SegmentSlice) -> Iterator[pa.RecordBatch]:
        error = part.error
        if not error:
            try:
                for batch in super().read_slice(part):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.string())], schema=_DRIVES_SCHEMA)
                return
            except OSError as e:  # a file that is gone is that drive's matter
                error = f"{type(e).__name__}: {e}"
        row = {"drive": [part.drive], "error": [error]}
        yield pa.RecordBatch.from_arrays([pa.array(row.get(f.name, [None]), f.type) for f in _DRIVES_SCHEMA], schema=_DRIVES_SCHEMA)


def drain(query: Any) -> None:
    """Lets a stream of bounded batches read all there is, and ends it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_drives(spark: SparkSession, drives: dict[str, tuple[str, int, int]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Entries of several drives, ``(folder, journal id, start)`` by letter, and by drive what kept it from being read.

    Whether a cursor still holds shows from the names of a journal's segments, so that a drive that fails is left out before any is read.
    """
    found, errors = None, {}
    for drive, (folder, journal_id, start) in drives.items():
        try:
            query_cursor(folder)
            UsnReader({"path": folder, "journalId": str(journal_id), "startingUsn": str(start)}).partitions()
        except (JournalError, OSError) as e:
            errors[drive] = f"{type(e).__name__}: {e}"
            continue
        own = read_journal(spark, folder, start, journal_id, drive)
        found = own if found is None else found.unionByName(own)
    return found, errors


def read_journal(spark: SparkSession, folder: str, start: int = 0, journal_id: int = 0, drive: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries from the cursor on."""
    spark.dataSource.register(UsnSource)
    reader = spark.read.format("usn_journal").option("path", folder).option("startingUsn", start).option("journalId", journal_id)
    return reader.option("drive", drive).option("rangeBytes", range_bytes).load()


def stream_journal(spark: SparkSession, folder: str, start: int = 0, journal_id: int = 0, drive: str = "", latest: bool = False, max_usn: int = 0, position: str = "") -> DataFrame:
    """The journal as a stream; journal id 0 with ``latest`` starts at the current end.

    Batches span at most ``max_usn`` USNs if given; ``position`` then names a file of the stream's own, beside its checkpoint.
    """
    spark.dataSource.register(UsnSource)
    reader = spark.readStream.format("usn_journal").option("path", folder).option("drive", drive)
    reader = reader.option("startingUsn", start).option("journalId", journal_id).option("startingOffset", "latest" if latest else "earliest")
    return reader.option("maxUsnPerBatch", max_usn).option("position", position).load()


def stream_drives(spark: SparkSession, drives: dict[str, tuple[str, int, int]], position: str, max_usn: int = 0) -> DataFrame:
    """The journals of many drives, ``(folder, journal id, start)`` by letter, as one stream; rows with an ``error`` tell of drives that failed.

    ``position`` names a file of the stream's own; batches span at most ``max_usn`` USNs of each drive if given.
    """
    spark.dataSource.register(UsnDrivesSource)
    given = {k: {"path": folder, "journal_id": str(journal), "next_usn": usn} for k, (folder, journal, usn) in drives.items()}
    return spark.readStream.format("usn_drives").option("drives", json.dumps(given)).option("position", position).option("maxUsnPerBatch", max_usn).load()
