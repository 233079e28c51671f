"""What names the chunks of an image can hold: their least and greatest one, and Bloom filters of names and of their runs of three characters.

The index of an image file is a file beside it with an entry of one size for every chunk of records, so that a task reads the entries of its own slice
and no other's, however long the image is. A chunk is skipped only if its entry shows that no name in it can match; what is read is still compared.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

from inodeon.sources import files

#: Characters of the least and greatest name that are kept, bytes of the two filters, and hashes of each.
ZONE, NAMES, RUNS = 32, 8192, 4096
NAME_HASHES, RUN_HASHES = 4, 2
ENTRY = 2 * ZONE + NAMES + RUNS
HEADER = struct.Struct("<4sI")
MAGIC = b"NIDX"
RUN = 3


def path_of(image: str) -> str:
    return f"{image}.names"


def _bits(keys: set[bytes], size: int, hashes: int) -> np.ndarray:
    """A filter of so many bytes with the keys in it; places come from halves of one hash."""
    h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
    bits = np.zeros(8 * size, dtype=bool)
    for i in range(hashes):
        bits[((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32))) % np.uint64(8 * size)] = True
    return np.packbits(bits)


def _runs(name: bytes) -> set[bytes]:
    return {name[i : i + RUN] for i in range(len(name) - RUN + 1)}


def entry(folded: pa.Array) -> bytes:
    """The entry of a chunk with these case-folded names; without any, nothing matches it."""
    names = {n.encode() for n in folded.unique().to_pylist()}
    low, high = (min(names)[:ZONE], max(names)[:ZONE]) if names else (b"\xff" * ZONE, b"")
    runs = set().union(*map(_runs, names)) if names else set()
    return low.ljust(ZONE, b"\0") + high.ljust(ZONE, b"\0") + _bits(names, NAMES, NAME_HASHES).tobytes() + _bits(runs, RUNS, RUN_HASHES).tobytes()


@dataclass(frozen=True)
class Search:
    """A case-folded name that is looked for as a whole, or as a part of names."""

    text: str
    exact: bool

    @cached_property
    def asked(self) -> np.ndarray:
        """The bits that an entry must have."""
        raw = self.text.encode()
        return _bits({raw}, NAMES, NAME_HASHES) if self.exact else _bits(_runs(raw), RUNS, RUN_HASHES)

    def possible(self, entry: bytes) -> bool:
        raw, asked = self.text.encode(), self.asked
        filters = np.frombuffer(entry, dtype=np.uint8)
        names, runs = filters[2 * ZONE : 2 * ZONE + NAMES], filters[2 * ZONE + NAMES :]
        if self.exact:
            low, high = entry[:ZONE].rstrip(b"\0"), entry[ZONE : 2 * ZONE].rstrip(b"\0")
            return low <= raw[:ZONE] <= high and bool((names & asked == asked).all())
        return entry[ZONE : 2 * ZONE].strip(b"\0") != b"" and bool((runs & asked == asked).all())


def write(image: str, per_entry: int, entries: list[bytes]) -> None:
    with files.create(path_of(image)) as out:
        out.write(HEADER.pack(MAGIC, per_entry))
        for e in entries:
            out.write(e)


def per_entry(image: str) -> int:
    """Records of an entry of an image file's index; 0 if it has none."""
    if not files.exists(path_of(image)):
        return 0
    magic, count = HEADER.unpack(files.read_range(path_of(image), 0, HEADER.size))
    return count if magic == MAGIC else 0


def entries(image: str, first: int, count: int) -> list[bytes]:
    raw = files.read_range(path_of(image), HEADER.size + first * ENTRY, count * ENTRY)
    return [raw[i : i + ENTRY] for i in range(0, len(raw), ENTRY)]
