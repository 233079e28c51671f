"""Decoding of file records: whole batches at once, with numpy; single records only where a volume's own table is located."""

from __future__ import annotations

import struct
import time

import numpy as np
import pyarrow as pa

from inodeon.model import RECORD_SIZE, REFERENCE_MASK

SECTOR = 512
STANDARD, LIST, NAME, DATA, END = 0x10, 0x20, 0x30, 0x80, 0xFFFFFFFF
DOS = 2


def _word(records: np.ndarray, at: np.ndarray, width: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Little-endian numbers of 2, 4 or 8 bytes at an offset of each record, or of those in some rows; offsets must lie inside."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    if rows is None and (at == at[0]).all():
        own = np.ascontiguousarray(records[:, at[0] : at[0] + width])
    else:
        place = (np.arange(len(records)) if rows is None else rows) * records.shape[1] + at
        own = records.reshape(-1)[place[:, None] + np.arange(width)]
    return own.view(f"<u{width}")[:, 0].astype(np.uint64)


def apply_fixups(records: np.ndarray) -> np.ndarray:
    """Restores the last words of the sectors in place; False where one of them was torn, from which on nothing is restored."""
    n, size = records.shape
    ok = np.ones(n, dtype=bool)
    array = _word(records, np.full(n, 4), 2).astype(np.int64)
    count = _word(records, np.full(n, 6), 2).astype(np.int64)
    has = count >= 2
    inside = array + 2 * count <= size
    ok[has & ~inside] = False
    has &= inside
    mark = np.zeros(n, dtype=np.uint64)
    mark[has] = _word(records[has], array[has], 2)
    for s in range(size // SECTOR):
        due = np.flatnonzero(has & ok & (count - 1 > s))
        if not len(due):
            break
        end = (s + 1) * SECTOR
        seen = records[due, end - 2].astype(np.uint64) | records[due, end - 1].astype(np.uint64) << np.uint64(8)
        good = seen == mark[due]
        ok[due[~good]] = False
        fix = due[good]
        records[fix, end - 2] = records[fix, array[fix] + 2 * (s + 1)]
        records[fix, end - 1] = records[fix, array[fix] + 2 * (s + 1) + 1]
    return ok


def strings(units: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that are laid end to end as UTF-16 units; plain ASCII needs no work by string."""
    ends = np.cumsum(lengths)
    if units.max(initial=0) < 0x80:
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(units.astype(np.uint8)))
    raw = units.astype("<u2").tobytes()
    return pa.array([raw[2 * (e - n) : 2 * e].decode("utf-16-le", "replace") for n, e in zip(lengths.tolist(), ends.tolist())], pa.string())


def units_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Texts laid end to end as UTF-16, and the ends of all of them in units; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    # a character's first byte says whether it takes one unit or two
    units = np.r_[0, np.cumsum(((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0))]
    return raw.tobytes().decode("utf-8").encode("utf-16-le"), units[ends[1:] - ends[0]]


def encode(found: dict[str, np.ndarray], record_size: int = RECORD_SIZE) -> bytes:
    """The on-disk bytes of records' columns: header, standard information, one name, end mark, and update sequence words; zeroed ones stay empty."""
    n = len(found["record_number"])
    out = np.zeros((n, record_size), dtype=np.uint8)
    every = np.arange(n)

    def put(at: int | np.ndarray, width: int, value: int | np.ndarray) -> None:
        raw = np.broadcast_to(np.asarray(value), n).astype("<i8").view(np.uint8).reshape(n, 8)[:, :width]
        if isinstance(at, int):
            out[:, at : at + width] = raw
        else:
            out[every[:, None], at[:, None] + np.arange(width)] = raw

    sectors = record_size // SECTOR
    first = (0x30 + 2 * (sectors + 1) + 7) // 8 * 8
    out[:, :4] = np.frombuffer(b"FILE", dtype=np.uint8)
    for at, width, value in ((0x04, 2, 0x30), (0x06, 2, sectors + 1), (0x14, 2, first), (0x16, 2, found["flags"]), (0x20, 8, found["base_reference"])):
        put(at, width, value)
    for at, width, value in ((0, 4, STANDARD), (4, 4, 0x18 + 48), (0x10, 4, 48), (0x14, 2, 0x18), (0x18 + 32, 4, found["file_attributes"])):
        put(first + at, width, value)
    name_at = first + 0x18 + 48
    names, ends = units_of(pa.array(found["file_name"], pa.string()))
    units = np.diff(np.r_[0, ends])
    size = 66 + 2 * units
    length = (0x18 + size + 7) // 8 * 8
    v = name_at + 0x18
    for at, width, value in ((name_at, 4, NAME), (name_at + 4, 4, length), (name_at + 0x10, 4, size), (name_at + 0x14, 2, 0x18)):
        put(at, width, value)
    for at, width, value in ((0, 8, found["parent_record_number"]), (48, 8, found["file_size"]), (56, 4, found["file_attributes"]), (64, 1, units), (65, 1, 3)):
        put(v + at, width, value)
    place = np.repeat(every * record_size + v + 66 - 2 * (ends - units), 2 * units) + np.arange(len(names))
    out.reshape(-1)[place] = np.frombuffer(names, dtype=np.uint8)
    put(name_at + length, 4, END)
    put(0x30, 2, found["record_number"] & 0xFFFF)
    for s in range(sectors):
        end = (s + 1) * SECTOR
        out[:, 0x32 + 2 * s : 0x34 + 2 * s] = out[:, end - 2 : end]
        out[:, end - 2 : end] = out[:, 0x30:0x32]
    out[found["zeroed"]] = 0
    return out.tobytes()


def decode(raw: bytes, first: int, record_size: int = RECORD_SIZE, spent: list[float] | None = None) -> dict[str, object]:
    """Columns of the live records among ``raw``: base records in use that have a name outside the DOS namespace.

    The name is the first resident one; attributes come from the standard information if it stands before that name, else
    from the name.
    """
    n = len(raw) // record_size
    records = np.frombuffer(raw, dtype=np.uint8, count=n * record_size).reshape(n, record_size)
    magic = (records[:, :4] == np.frombuffer(b"FILE", dtype=np.uint8)).all(axis=1)
    flags = _word(records, np.full(n, 0x16), 2).astype(np.int64)  # none of these words ends a sector
    base = _word(records, np.full(n, 0x20), 8) & np.uint64(REFERENCE_MASK)
    live = np.flatnonzero(magic & ((flags & 1) != 0) & (base == 0))
    records, number, flags = records[live], first + live, flags[live]
    began = time.perf_counter()
    fixed = apply_fixups(records) if len(records) else np.zeros(0, dtype=bool)
    if spent is not None:  # the seconds that fixups took
        spent.append(time.perf_counter() - began)
    m = len(records)
    at = _word(records, np.full(m, 0x14), 2).astype(np.int64) if m else np.zeros(0, dtype=np.int64)
    name_at, standard = np.full(m, -1), np.full(m, -1, dtype=np.int64)
    going = np.arange(m)
    while len(going):
        going = going[at[going] + 24 <= record_size]
        p = at[going]
        kind, length = _word(records, p, 4, going), _word(records, p + 4, 4, going).astype(np.int64)
        on = (kind != END) & (length > 0)
        going, p, kind, length = going[on], p[on], kind[on], length[on]
        resident = records[going, p + 8] == 0
        value = p + _word(records, p + 0x14, 2, going).astype(np.int64)
        si = resident & (kind == STANDARD) & (value + 36 <= record_size)
        standard[going[si]] = _word(records, value[si] + 32, 4, going[si]).astype(np.int64)
        named = resident & (kind == NAME) & (value + 66 <= record_size)
        v = value[named]
        long_enough = np.zeros(len(going), dtype=bool)
        sub = np.flatnonzero(named)
        own = records[going[sub], v + 65] != DOS
        whole = v + 66 + 2 * records[going[sub], v + 64].astype(np.int64) <= record_size
        long_enough[sub[own & whole]] = True
        name_at[going[long_enough]] = value[long_enough]
        at[going] = p + length
        going = going[~long_enough]
    has = np.flatnonzero(name_at >= 0)
    if len(has) < m:
        records, number, fixed, flags, name_at, standard = records[has], number[has], fixed[has], flags[has], name_at[has], standard[has]
    m = len(records)
    parent = (_word(records, name_at, 8) & np.uint64(REFERENCE_MASK)).astype(np.int64) if m else np.zeros(0, dtype=np.int64)
    own = _word(records, name_at + 56, 4).astype(np.int64) if m else np.zeros(0, dtype=np.int64)
    lengths = records[np.arange(m), name_at + 64].astype(np.int64)
    before = np.cumsum(lengths) - lengths
    place = np.repeat(np.arange(m) * record_size + name_at + 66 - 2 * before, lengths) + 2 * np.arange(int(lengths.sum()))
    flat = records.reshape(-1)
    units = flat[place] | flat[place + 1].astype(np.uint16) << np.uint16(8)
    folded = np.where((units >= 0x41) & (units <= 0x5A), units + np.uint16(32), units)
    return {
        "record_number": number,
        "parent_record_number": parent,
        "flags": flags.astype(np.int32),
        "file_attributes": np.where(standard >= 0, standard, own),
        "file_name": strings(units, lengths),
        "name_fold": strings(folded, lengths),
        "fixup_ok": fixed,
    }


# The few records that say where a volume keeps its table.


def attribute(record: bytes, kind: int) -> int:
    """Offset of the first attribute of a kind, or -1."""
    at = struct.unpack_from("<H", record, 0x14)[0]
    while at + 16 <= len(record):
        found, length = struct.unpack_from("<II", record, at)
        if found == END or length == 0:
            return -1
        if found == kind:
            return at
        at += length
    return -1


def data_runs(record: bytes, at: int) -> list[tuple[int, int, bool]]:
    """``(cluster, count, sparse)`` of a non-resident attribute; offsets add up; a resident one has none."""
    if record[at + 8] == 0:
        return []
    end = min(len(record), at + struct.unpack_from("<I", record, at + 4)[0])
    p = at + struct.unpack_from("<H", record, at + 0x20)[0]
    out, cluster = [], 0
    while p < end and record[p] & 15:
        n, m = record[p] & 15, record[p] >> 4
        if p + 1 + n + m > end:
            break
        count = int.from_bytes(record[p + 1 : p + 1 + n], "little")
        cluster += int.from_bytes(record[p + 1 + n : p + 1 + n + m], "little", signed=True)
        out.append((cluster, count, m == 0))
        p += 1 + n + m
    return out


def fixed_record(raw: bytes) -> bytes:
    records = np.frombuffer(raw, dtype=np.uint8).reshape(1, -1).copy()
    apply_fixups(records)
    return records.tobytes()


def with_attributes(raw: bytes, added: list[bytes]) -> bytes:
    """A record with attributes behind its own ones, its update sequence words in place again."""
    record = bytearray(fixed_record(raw))
    at = struct.unpack_from("<H", record, 0x14)[0]
    while struct.unpack_from("<I", record, at)[0] != END:
        at += struct.unpack_from("<I", record, at + 4)[0]
    for one in added:
        record[at : at + len(one)] = one
        at += len(one)
    struct.pack_into("<I", record, at, END)
    array = struct.unpack_from("<H", record, 4)[0]
    for s in range(len(record) // SECTOR):
        end = (s + 1) * SECTOR
        record[array + 2 * (s + 1) : array + 2 * (s + 2)] = record[end - 2 : end]
        record[end - 2 : end] = record[array : array + 2]
    return bytes(record)


def data_attribute(runs: list[tuple[int, int]]) -> bytes:
    """A non-resident data attribute of ``(cluster, count)`` runs, each four bytes long in count and offset."""
    body, last = b"", 0
    for cluster, count in runs:
        body += b"\x44" + count.to_bytes(4, "little") + (cluster - last).to_bytes(4, "little", signed=True)
        last = cluster
    size = (0x40 + len(body) + 1 + 7) // 8 * 8
    out = bytearray(size)
    struct.pack_into("<IIB", out, 0, DATA, size, 1)
    struct.pack_into("<H", out, 0x20, 0x40)
    out[0x40 : 0x40 + len(body)] = body
    return bytes(out)


def list_attribute(segments: list[int]) -> bytes:
    """A resident attribute list that names other records as holders of data."""
    content = b"".join(struct.pack("<IHBBQQ", DATA, 32, 0, 0, 0, s).ljust(32, b"\0") for s in segments)
    return struct.pack("<IIBBHHHIHH", LIST, 24 + len(content), 0, 0, 0, 0, 0, len(content), 24, 0) + content


def listed_segments(content: bytes) -> list[int]:
    """Other records of an attribute list, in order of first appearance."""
    out: dict[int, None] = {}
    at = 0
    while at + 26 <= len(content):
        length = struct.unpack_from("<H", content, at + 4)[0]
        if length == 0:
            break
        segment = struct.unpack_from("<Q", content, at + 16)[0] & REFERENCE_MASK
        if segment:
            out.setdefault(segment)
        at += length
    return list(out)
