"""Wire frames between a scanner and its clients: ``[length i32][kind u8][fields]``, little-endian, texts in UTF-16 with their length.

The layout of each kind is a table of named fields; one reader and one writer follow it.
"""

from __future__ import annotations

import struct
from typing import Any

# Fixed values of the format: frame kinds with their fields.
KINDS: dict[str, tuple[int, tuple[tuple[str, str], ...]]] = {
    "ArmAndScan": (1, (("drives_spec", "text"), ("keep_names", "texts"))),
    "StartWatch": (2, (("drives_spec", "text"),)),
    "Shutdown": (3, ()),
    "ScanReady": (4, (("map_name", "text"), ("record_count", "q"), ("byte_length", "q"))),
    "Cursor": (5, (("drive", "text"), ("journal_id", "Q"), ("next_usn", "q"))),
    "JournalBatch": (6, (("drive", "text"), ("journal_id", "Q"), ("next_usn", "q"), ("entries", "entries"))),
    "Error": (7, (("drive", "text"), ("message", "text"))),
    "Heartbeat": (8, ()),
    "EndWatch": (9, ()),
    "EndWatchAck": (10, ()),
}
_BY_NUMBER = {number: (kind, fields) for kind, (number, fields) in KINDS.items()}
#: Of a change record: record, parent, USN, ticks, reason, attributes; the name follows.
_ENTRY = struct.Struct("<QQqqII")


class InvalidFrame(ValueError):
    pass


def _put(kind: str, value: Any) -> bytes:
    if kind == "text":
        raw = value.encode("utf-16-le")
        return struct.pack("<i", len(raw)) + raw
    if kind == "texts":
        return struct.pack("<i", len(value)) + b"".join(_put("text", v) for v in value)
    if kind == "entries":
        return struct.pack("<i", len(value)) + b"".join(_ENTRY.pack(*e[:6]) + _put("text", e[6]) for e in value)
    return struct.pack("<" + kind, value)


def _get(kind: str, raw: bytes, at: int) -> tuple[Any, int]:
    if kind == "text":
        n = struct.unpack_from("<i", raw, at)[0]
        if n < 0 or at + 4 + n > len(raw):
            raise InvalidFrame("a text runs beyond its frame")
        return raw[at + 4 : at + 4 + n].decode("utf-16-le"), at + 4 + n
    if kind in ("texts", "entries"):
        n, at = struct.unpack_from("<i", raw, at)[0], at + 4
        out = []
        for _ in range(n):
            fixed: tuple = ()
            if kind == "entries":
                fixed, at = _ENTRY.unpack_from(raw, at), at + _ENTRY.size
            text, at = _get("text", raw, at)
            out.append((*fixed, text) if fixed else text)
        return out, at
    return struct.unpack_from("<" + kind, raw, at)[0], at + struct.calcsize(kind)


def write(kind: str, **values: Any) -> bytes:
    number, fields = KINDS[kind]
    missing = [name for name, what in fields if name not in values and what != "texts"]
    if missing or set(values) - {name for name, _ in fields}:
        raise InvalidFrame(f"{kind} takes {[name for name, _ in fields]}, not {sorted(values)}")
    body = b"".join(_put(what, values.get(name, [])) for name, what in fields)
    return struct.pack("<iB", 1 + len(body), number) + body


def read(raw: bytes) -> tuple[str, dict[str, Any], int]:
    """Kind, fields, and the bytes that the frame takes."""
    length, number = struct.unpack_from("<iB", raw)
    if number not in _BY_NUMBER:
        raise InvalidFrame(f"unknown frame kind {number}")
    kind, fields = _BY_NUMBER[number]
    frame, at, values = raw[: 4 + length], 5, {}
    for name, what in fields:
        values[name], at = _get(what, frame, at)
    return kind, values, 4 + length
