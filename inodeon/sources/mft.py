"""Data source ``mft``: file record tables in image files and volumes, read in parallel by ranges of records.

Options: ``path``, a file or a folder of ``part-<first record>.mft`` files; ``layout`` image (default) or volume; ``recordSize`` (1024),
``recordsPerPartition`` (65536; if there are many such parts, a task reads several), ``drive``; ``skipPrefix`` true for images with 20 bytes before the first record, auto to look whether there
are. With ``pushFilters`` true, for which
``spark.sql.python.filterPushdown.enabled`` must be set, predicates on ``name_fold``, ``in_use``, ``is_directory`` and ``record_number``
are taken over by the reader. Spark keeps what was pushed with the loaded frame, also for other uses of that frame; so load one
for each predicate then, and resolve paths against another. It is off by default.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan, StringContains, WriterCommitMessage

from inodeon.model import MFT_RECORDS, RECORD_SIZE, MatchFlags
from inodeon.sources import files, nameindex, ntfs, synthetic

PREFIX = 20
CHUNK = 8192
#: Records of a neighbourhood, bytes that are rather read than skipped, and bytes of one read at most, when single records are looked up.
NEIGHBOURS = 65_536
GAP = 32 << 10
READ_BYTES = 8 << 20
#: Slices beyond so many are read by a task together, and files written, as long as a task has no more than so many records. A task of Python's costs
#: some 0.3 s before it reads, and what shuffles behind it opens a file for each of its own partitions.
TASKS = 36
TASK_RECORDS = 262_144
#: With ``measured``, the first row of every chunk says what the chunk took; a chunk without live records has such a row without a record.
MEASURES = "slots long, bytes long, io_ms double, fixup_ms double, parse_ms double"


@dataclass
class Slice(InputPartition):
    """Records first..first+count-1, stored in a file from an offset on."""

    first: int
    count: int
    offset: int
    path: str


@dataclass
class Group(InputPartition):
    """Neighbouring slices that one task reads."""

    parts: list[Slice]


def dealt(slices: list[Slice]) -> list[Group]:
    """The slices in groups; each has its own as long as they are few."""
    room = min(TASK_RECORDS, sum(s.count for s in slices) // TASKS)
    groups: list[Group] = []
    left = 0
    for s in slices:
        if s.count > left:
            groups.append(Group([]))
            left = room
        groups[-1].parts.append(s)
        left -= s.count
    return groups


class MftSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mft"

    def schema(self) -> str:
        measured = {k.lower(): v for k, v in self.options.items()}.get("measured", "false").lower() == "true"
        return f"{MFT_RECORDS}, {MEASURES}" if measured else MFT_RECORDS

    def reader(self, schema: object) -> DataSourceReader:
        options = dict(self.options)
        push = {k.lower(): v for k, v in options.items()}.get("pushfilters", "false").lower() == "true"
        return PushingReader(options) if push else MftReader(options)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return ImageWriter(dict(self.options))


class MftReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.path = get("path") or ""
        self.layout = get("layout", "image")
        self.record_size = int(get("recordsize", str(RECORD_SIZE)))
        self.per_partition = int(get("recordsperpartition", "65536"))
        self.drive = get("drive", "")
        self.skip = get("skipprefix", "false").lower()
        self.measured = get("measured", "false").lower() == "true"
        name, part = get("nameis"), get("namecontains")
        self.search = nameindex.Search(name, True) if name is not None else nameindex.Search(part, False) if part is not None else None
        self.filters: list[Filter] = []

    def extents(self) -> list[tuple[str, int | None, int, int]]:
        """``(file, first record, offset, bytes)`` of the table's pieces, in record order; None goes on from the piece before."""
        if self.layout == "volume":
            return [(self.path, None, offset, length) for offset, length in volume_extents(self.path, self.record_size)]
        if self.layout != "image":
            raise ValueError(f"unknown layout {self.layout!r}")
        if files.is_folder(self.path):
            parts = [(f"{self.path}/{n}", int(n.removeprefix("part-").removesuffix(".mft")), size) for n, size in files.sizes(self.path, ".mft")]
        else:
            parts = [(self.path, None, files.size(self.path))]
        # all parts of an image are written alike
        start = PREFIX if self.skip == "true" or self.skip == "auto" and parts and has_prefix(parts[0][0]) else 0
        return [(path, first, start, size - start) for path, first, size in parts]

    def partitions(self) -> list[Group]:
        return dealt(self.slices())

    def slices(self) -> list[Slice]:
        out, after = [], 0
        for path, first, offset, length in self.extents():
            first = after if first is None else first
            total = length // self.record_size
            for at in range(0, total, self.per_partition):
                out.append(Slice(first + at, min(self.per_partition, total - at), offset + at * self.record_size, path))
            after = first + total
        return out

    def chunks(self, part: Slice) -> Iterator[tuple[int, int]]:
        """``(at, n)``: the records of a slice that are to be read, at most CHUNK at once; those that an index rules out are left."""
        step = nameindex.per_entry(part.path) if self.search and self.layout == "image" else 0
        # entries count from the file's first record, which stands where the prefix ends
        begin = part.offset // self.record_size
        if not step or begin % step:
            yield from ((at, min(CHUNK, part.count - at)) for at in range(0, part.count, CHUNK))
            return
        known = nameindex.entries(part.path, begin // step, -(-part.count // step))
        ahead: tuple[int, int] | None = None
        for at, e in zip(range(0, part.count, step), known):
            if not self.search.possible(e):
                continue
            n = min(step, part.count - at)
            if ahead and sum(ahead) == at and ahead[1] + n <= CHUNK:
                ahead = (ahead[0], ahead[1] + n)
                continue
            if ahead:
                yield ahead
            ahead = (at, n)
        if ahead:
            yield ahead

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        for part in group.parts:
            yield from self.read_slice(part)

    def read_slice(self, part: Slice) -> Iterator[pa.RecordBatch]:
        for at, n in self.chunks(part):
            marks = [time.perf_counter()]
            raw = self._raw(part, at, n)
            marks.append(time.perf_counter())
            spent: list[float] = []
            batch = self._batch(ntfs.decode(raw, part.first + at, self.record_size, spent))
            marks.append(time.perf_counter())
            if self.measured:
                io, decoded = (1000 * (b - a) for a, b in zip(marks, marks[1:]))
                batch = _measured(batch, [n, len(raw), io, 1000 * sum(spent), decoded - 1000 * sum(spent)])
            yield batch

    def _raw(self, part: Slice, at: int, n: int) -> bytes:
        raw = files.read_range(part.path, part.offset + at * self.record_size, n * self.record_size)
        if len(raw) != n * self.record_size:
            raise OSError(f"{part.path}: {n} records from {part.first + at} on can't be read")
        return raw

    def _batch(self, found: dict) -> pa.RecordBatch:
        flags = found["flags"]
        columns = {
            "drive": pa.repeat(pa.scalar(self.drive, pa.string()), len(flags)),
            "record_number": pa.array(found["record_number"], pa.int64()),
            "parent_record_number": pa.array(found["parent_record_number"], pa.int64()),
            "flags": pa.array(flags, pa.int32()),
            "in_use": pa.array((flags & 1) != 0),
            "is_directory": pa.array((flags & 2) != 0),
            "file_attributes": pa.array(found["file_attributes"], pa.int64()),
            "file_name": found["file_name"],
            "name_fold": found["name_fold"],
            "fixup_ok": pa.array(found["fixup_ok"], pa.bool_()),
        }
        batch = pa.RecordBatch.from_pydict(columns)
        for f in self.filters:
            column = batch.column(f.attribute[0])
            if isinstance(f, StringContains):
                keep = pc.match_substring(column, f.value)
            else:
                keep = (pc.equal if isinstance(f, EqualTo) else pc.greater_equal if isinstance(f, GreaterThanOrEqual) else pc.less)(column, f.value)
            batch = batch.filter(keep)
        return batch


def _measured(batch: pa.RecordBatch, values: list) -> pa.RecordBatch:
    """The batch with the measures of its chunk in its first row."""
    names = [m.split()[0] for m in MEASURES.split(", ")]
    rows = max(1, batch.num_rows)
    own = [c if batch.num_rows else pa.nulls(1, c.type) for c in batch.columns]
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
    more = [pa.concat_arrays([pa.array([v], t), pa.nulls(rows - 1, t)]) for v, t in zip(values, kinds)]
    return pa.RecordBatch.from_arrays([*own, *more], [*batch.schema.names, *names])


def measured_image(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, Observation]:
    """The live records, and what the scan that reads them comes to, once an action has run over them.

    The observation has total_records, used_records, bytes, io_ms, fixup_ms and parse_ms, summed over all tasks of that one pass, whatever
    is made of the records after it.
    """
    seen = Observation()
    rows = read_image(spark, path, measured=True, **options)
    names = [m.split()[0] for m in MEASURES.split(", ")]
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias("total_records" if n == "slots" else n) for n in names]
    rows = rows.observe(seen, *sums, F.count("record_number").alias("used_records"))
    return rows.where("record_number is not null").drop(*names), seen


def index_names(spark: SparkSession, path: str, per_entry: int = CHUNK, **options: object) -> None:
    """Writes an index of names beside every file of an image, a task for each file or, if they are many, for some; an image in one file is read by one task."""
    reader = MftReader({"path": path, **{k: str(v) for k, v in options.items()}})
    if reader.layout != "image":
        raise ValueError("a volume's table has no index of names")
    pieces = [(file, offset, length // reader.record_size) for file, _, offset, length in reader.extents()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, total in zip(*(c.to_pylist() for c in batch.columns)):
                whole, made = Slice(0, total, offset, file), []
                for at in range(0, total, per_entry):
                    found = ntfs.decode(reader._raw(whole, at, min(per_entry, total - at)), at, reader.record_size)
                    made.append(nameindex.entry(found["name_fold"]))
                nameindex.write(file, per_entry, made)
            yield batch.select(["count"])

    tasks = min(len(pieces), max(TASKS, -(-sum(total for *_, total in pieces) // TASK_RECORDS)))
    spark.createDataFrame(pieces, "path string, offset long, count long").repartition(max(1, tasks), "path").mapInArrow(run, "count long").count()


def search_image(spark: SparkSession, path: str, text: str, flags: MatchFlags = MatchFlags.EXACT, **options: object) -> tuple[DataFrame, Observation]:
    """The records whose name matches, and what the scan for them came to: chunks that the index of names rules out are not read."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    own = {"nameIs" if flags & MatchFlags.EXACT else "nameContains": folded}
    rows, seen = measured_image(spark, path, **own, **options)
    return rows.where(F.col("name_fold") == folded if flags & MatchFlags.EXACT else F.col("name_fold").contains(folded)), seen


def write_records(spark: SparkSession, rows: DataFrame, folder: str, per_file: int = CHUNK) -> None:
    """An image of the rows ``(record_number, parent_record_number, flags, file_attributes, file_name)``, in files of neighbouring numbers, a task each.

    Slots of numbers that no row has are empty.
    """

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by("record_number")
        number = part.column("record_number").to_numpy()
        first = int(number[0])
        at = number - first
        n = int(at[-1]) + 1
        found = {"record_number": np.arange(first, first + n), "zeroed": np.ones(n, dtype=bool), "base_reference": np.zeros(n, np.int64), "file_size": np.zeros(n, np.int64)}
        found["zeroed"][at] = False
        for name in ("parent_record_number", "flags", "file_attributes"):
            found[name] = np.zeros(n, np.int64)
            found[name][at] = part.column(name).to_numpy()
        names = np.full(n, "", dtype=object)
        names[at] = part.column("file_name").to_pylist()
        path = f"{folder}/part-{first:012d}.mft"
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with files.create(own) as out:
            out.write(ntfs.encode(found | {"file_name": names}))
        files.rename(own, path)
        return part.select(["record_number"]).slice(0, 1)

    kinds = {"record_number": "long", "parent_record_number": "long", "flags": "long", "file_attributes": "long", "file_name": "string"}
    cast = rows.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), F.floor(F.col("record_number") / per_file).alias("file"))
    cast.groupBy("file").applyInArrow(write, "record_number long").count()


class PushingReader(MftReader):
    """A reader that takes over predicates; Spark accepts one only where its setting allows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            taken = column in (("name_fold",), ("in_use",), ("is_directory",)) and isinstance(f, (EqualTo, StringContains))
            taken = taken or column == ("record_number",) and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThan))
            if taken:
                self.filters.append(f)
            else:
                yield f


def has_prefix(path: str) -> bool:
    """Whether a record's mark stands behind a prefix and none at the start."""
    head = files.read_range(path, 0, PREFIX + 4)
    return head[:4] != b"FILE" and head[PREFIX:] == b"FILE"


def volume_extents(path: str, record_size: int = RECORD_SIZE) -> list[tuple[int, int]]:
    """Where a volume keeps its table: the data runs of record 0 and of the records that its attribute list names."""
    boot = files.read_range(path, 0, 512)
    if boot[3:7] != b"NTFS":
        raise ValueError(f"{path} is not an NTFS volume")
    cluster = struct.unpack_from("<H", boot, 0x0B)[0] * boot[0x0D]
    start = struct.unpack_from("<Q", boot, 0x30)[0] * cluster
    record = ntfs.fixed_record(files.read_range(path, start, record_size))
    if record[:4] != b"FILE":
        raise ValueError(f"{path}: record 0 is no file record")
    at = ntfs.attribute(record, ntfs.DATA)
    runs = ntfs.data_runs(record, at) if at >= 0 else []
    if not runs:
        raise ValueError(f"{path}: record 0 has no data runs")
    pieces = [(c * cluster, n * cluster) for c, n, _ in runs]
    at = ntfs.attribute(record, ntfs.LIST)
    if at >= 0:
        if record[at + 8] == 0:
            length, offset = struct.unpack_from("<IH", record, at + 0x10)
            content = record[at + offset : at + offset + length]
        else:
            length = struct.unpack_from("<Q", record, at + 0x30)[0]
            content = b"".join(files.read_range(path, c * cluster, n * cluster) for c, n, _ in ntfs.data_runs(record, at))[:length]
        for number in ntfs.listed_segments(content):
            place = number * record_size
            for offset, length in list(pieces):
                if place < length:
                    extension = ntfs.fixed_record(files.read_range(path, offset + place, record_size))
                    data = ntfs.attribute(extension, ntfs.DATA) if extension[:4] == b"FILE" else -1
                    if data >= 0:
                        pieces += [(c * cluster, n * cluster) for c, n, _ in ntfs.data_runs(extension, data)]
                    break
                place -= length
    return pieces


@dataclass
class Part(WriterCommitMessage):
    path: str


class ImageWriter(DataSourceWriter):
    """Synthetic images: rows ``(first long, count long)``, one file ``part-<first>.mft`` for each.

    With ``tornEvery`` k, every k-th record has a torn sector: its last word isn't the record's mark. With ``prefix`` true, 20 bytes stand before
    the first record of each file.
    """

    def __init__(self, options: dict[str, str]) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.path = get("path") or ""
        self.torn = int(get("tornevery", "0"))
        self.prefix = get("prefix", "false").lower() == "true"

    def write(self, rows: Iterator) -> Part:
        last = ""
        for first, count in rows:
            last = f"{self.path}/part-{first:012d}.mft"
            with files.create(last) as out:
                out.write(b"\0" * PREFIX * self.prefix)
                for at in range(first, first + count, CHUNK):
                    raw = bytearray(synthetic.image(at, min(at + CHUNK, first + count)))
                    if self.torn:
                        for i in range(-(at + 1) % self.torn, len(raw) // RECORD_SIZE, self.torn):
                            raw[i * RECORD_SIZE + 510] ^= 0xFF
                    out.write(raw)
        return Part(last)


def point_reads(spark: SparkSession, wanted: DataFrame, path: str, **options: object) -> DataFrame:
    """The live records among some ``record_number``s, and with each what was ``bytes_read`` for it and others at once (on the first one only).

    Numbers are dealt out by neighbourhoods of ``NEIGHBOURS`` records, so that those close to each other are looked up by one task; the pieces of the
    table, by the sums of their lengths, say where each lies, and numbers whose records are at most ``GAP`` bytes apart are read at once, ``READ_BYTES`` at most.
    """
    reader = MftReader({"path": path, **{k: str(v) for k, v in options.items()}})
    size = reader.record_size
    pieces, after = [], 0
    for file, first, offset, length in reader.extents():
        first = after if first is None else first
        after = first + length // size
        pieces.append((first, after, offset, file))
    starts = np.array([p[0] for p in pieces], dtype=np.int64)

    def reads(numbers: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
        """``(file, offset, numbers)``: numbers that are read at once, and where the first of them lies."""
        piece = np.searchsorted(starts, numbers, "right") - 1
        inside = np.array([k >= 0 and n < pieces[k][1] for k, n in zip(piece.tolist(), numbers.tolist())], dtype=bool)
        piece, numbers = piece[inside], numbers[inside]
        cuts = np.flatnonzero((np.diff(piece) != 0) | (np.diff(numbers) > GAP // size) | (np.diff(numbers // (READ_BYTES // size)) != 0)) + 1
        for own, some in zip(np.split(numbers, cuts), np.split(piece, cuts)):
            if len(own):
                first, _, offset, file = pieces[some[0]]
                yield file, offset + (int(own[0]) - first) * size, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, numbers in reads(batch.column(0).to_numpy()) if pieces else ():
                length = int(numbers[-1] - numbers[0] + 1) * size
                raw = np.frombuffer(files.read_range(file, offset, length), dtype=np.uint8).reshape(-1, size)
                found = ntfs.decode(raw[numbers - numbers[0]].tobytes(), 0, size)
                rows = len(found["record_number"])
                found["record_number"] = numbers[found["record_number"]]
                out = reader._batch(found)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([length] + [0] * (rows - 1) if rows else [], pa.int64())], [*out.schema.names, "bytes_read"])

    numbers = wanted.where("record_number >= 0").select(F.col("record_number").cast("long").alias("record_number")).distinct()
    dealt = numbers.repartition(F.floor(F.col("record_number") / NEIGHBOURS)).sortWithinPartitions("record_number")
    return dealt.mapInArrow(run, f"{MFT_RECORDS}, bytes_read long")


def write_synthetic(path: str, n: int) -> None:
    """One image file of n synthetic records, a chunk at a time."""
    with files.create(path) as out:
        for at in range(0, n, CHUNK):
            out.write(synthetic.image(at, min(at + CHUNK, n)))


def write_image(spark: SparkSession, folder: str, n: int, per_file: int = CHUNK, **options: object) -> None:
    """A folder of image files with n synthetic records, a task for each file or, if they are many, for some."""
    spark.dataSource.register(MftSource)
    parts = -(-n // per_file)
    tasks = min(parts, max(TASKS, -(-n // TASK_RECORDS)))
    ranges = spark.range(0, n, per_file, max(1, tasks)).selectExpr("id as first", f"least({per_file}L, {n} - id) as count")
    writer = ranges.write.format("mft").option("path", folder)
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.mode("append").save()


def write_volume(path: str, n: int) -> None:
    """A volume of n synthetic records whose table lies in four runs out of order, the last two of them named by an extension record."""
    cluster, total = 4096, -(-n * RECORD_SIZE // 4096)
    lengths = [max(25, total // 4)] * 3
    lengths.append(max(1, total - sum(lengths)))
    slots = [0, 2, 1, 3]  # where each run lies among the runs on disk
    starts = [0] * 4
    at = 16
    for slot in range(4):
        run = slots.index(slot)
        starts[run] = at
        at += lengths[run] + 5
    first = synthetic.rows(0, 100)
    extension = int(np.flatnonzero(first["base_reference"] > 0)[0])
    runs = list(zip(starts, lengths))
    special = {
        0: ntfs.with_attributes(synthetic.image(0, 1), [ntfs.list_attribute([extension]), ntfs.data_attribute(runs[:2])]),
        extension: ntfs.with_attributes(synthetic.image(extension, extension + 1), [ntfs.data_attribute(runs[2:])]),
    }
    boot = bytearray(cluster)
    boot[3:7] = b"NTFS"
    struct.pack_into("<HB", boot, 0x0B, 512, cluster // 512)
    struct.pack_into("<Q", boot, 0x30, starts[0])
    per = cluster // RECORD_SIZE
    with files.create(path) as out:
        out.write(bytes(boot) + b"\xaa" * (15 * cluster))
        for slot in range(4):
            run = slots.index(slot)
            low = sum(lengths[:run]) * per
            for a in range(low, low + lengths[run] * per, CHUNK):
                z = min(a + CHUNK, low + lengths[run] * per)
                raw = bytearray(synthetic.image(a, max(a, min(z, n)))).ljust((z - a) * RECORD_SIZE, b"\0")
                for number, record in special.items():
                    if a <= number < z:
                        raw[(number - a) * RECORD_SIZE : (number - a + 1) * RECORD_SIZE] = record
                out.write(raw)
            out.write(b"\xaa" * (5 * cluster))


def read_image(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The live records of an image or volume."""
    spark.dataSource.register(MftSource)
    reader = spark.read.format("mft").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


class Volume:
    """An image or volume that is open until it is closed; then nothing can be read from it."""

    def __init__(self, spark: SparkSession, path: str, **options: object) -> None:
        self.path = path
        self._open: tuple[SparkSession, dict[str, object]] | None = (spark, options)
        MftReader({"path": path, **{k: str(v) for k, v in options.items()}}).extents()  # what can't be opened shows at once

    def records(self) -> DataFrame:
        """The live records."""
        if self._open is None:
            raise RuntimeError(f"{self.path} is closed")
        spark, options = self._open
        return read_image(spark, self.path, **options)

    def close(self) -> None:
        self._open = None

    def __enter__(self) -> Volume:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def slots_of(path: str, **options: object) -> int:
    """All slots of an image or volume, as its files say."""
    reader = MftReader({"path": path, **{k: str(v) for k, v in options.items()}})
    return sum(length // reader.record_size for *_, length in reader.extents())


def total_records(path: str, record_size: int = RECORD_SIZE) -> int:
    """All slots of an image; a tail shorter than a record doesn't count."""
    return files.size(path) // record_size
