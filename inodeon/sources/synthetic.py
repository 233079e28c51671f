"""Deterministic synthetic record tables: logical rows by record index, and their on-disk bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from inodeon.sources import ntfs

# Fixed values of the generator, which its results depend on.
FILE_NAMES = ("README.md", "index.html", "main.cpp", "package.json", "Makefile", "config.yaml", "data.bin", "icon.png", "setup.py", "app.js", "style.css", "test.go", "build.gradle", "Cargo.toml", "Program.cs", "pom.xml")
DIR_NAMES = ("src", "bin", "obj", "node_modules", ".git", "build", "docs", "tests", "lib", "include", "assets", "scripts", "config", "data", "temp", "cache")
SEED = 12345678901
MULTIPLIER = 6364136223846793005
ROWS = "record_number long, parent_record_number long, flags int, base_reference long, zeroed boolean, file_attributes long, file_size long, file_name string"

_LOW = np.uint64(0xFFFFFFFF)


class _Draws:
    """One xorshift stream for each record, drawn from for a subset at a time."""

    def __init__(self, index: np.ndarray) -> None:
        self.state = np.uint64(SEED) ^ (index * np.uint64(MULTIPLIER) + np.uint64(1))

    def next(self, rows: np.ndarray) -> np.ndarray:
        x = self.state[rows]
        x ^= x << np.uint64(13)
        x ^= x >> np.uint64(7)
        x ^= x << np.uint64(17)
        self.state[rows] = x
        return x


def rows(start: int, stop: int) -> dict[str, np.ndarray]:
    """Columns of ROWS for the records start..stop-1."""
    with np.errstate(over="ignore"):
        index = np.arange(start, stop, dtype=np.uint64)
        n = len(index)
        draws = _Draws(index)
        everyone = np.arange(n)
        roll = (draws.next(everyone) & _LOW) % np.uint64(100)
        system, root = index < 5, index == 5
        ordinary = index > 5
        zeroed = ordinary & (roll < 10)
        extension = ordinary & (roll >= 10) & (roll < 25)
        directory = ordinary & (roll >= 25) & (roll < 40)
        file = ordinary & (roll >= 40)
        parent, base = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        parent[root] = 5
        at = np.flatnonzero(extension)
        base[at] = (draws.next(at) & _LOW) % index[at] + np.uint64(1)
        named = directory | file
        parent[named] = 5
        at = np.flatnonzero(named & (index >= 100))
        parent[at] = (draws.next(at) & _LOW) % (index[at] // np.uint64(2)) + np.uint64(5)
        at = np.flatnonzero(named)
        pick = np.zeros(n, dtype=np.int64)
        pick[at] = ((draws.next(at) & _LOW) % np.uint64(16)).astype(np.int64)
        names = np.full(n, "", dtype=object)
        names[system], names[root], names[extension] = "$MFT", ".", "ext"
        names[directory] = np.array(DIR_NAMES, dtype=object)[pick[directory]]
        names[file] = np.array(FILE_NAMES, dtype=object)[pick[file]]
        flags = np.where(zeroed, 0, np.where(directory | root, 3, 1))
        # times, size and attributes are rolled last, from whole 64-bit draws
        live = np.flatnonzero(~zeroed)
        folder = (flags[live] & 2) != 0
        for _ in range(4):
            draws.next(live)
        sizes = np.zeros(n, dtype=np.int64)
        sizes[live[~folder]] = (draws.next(live[~folder]) % np.uint64(256 << 20)).astype(np.int64)
        attributes = np.zeros(n, dtype=np.int64)
        attributes[live] = np.where(folder, 0x10, 0x20)
        for bit, odds in ((0x02, 20), (0x04, 50), (0x01, 10)):
            attributes[live] |= np.where(draws.next(live) % np.uint64(odds) == 0, bit, 0)
    return {
        "record_number": index.astype(np.int64),
        "parent_record_number": parent.astype(np.int64),
        "flags": flags.astype(np.int32),
        "base_reference": base.astype(np.int64),
        "zeroed": zeroed,
        "file_attributes": attributes,
        "file_size": sizes,
        "file_name": names,
    }


def records(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """The logical rows of a table of n records, zeroed slots and extensions included."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                found = rows(int(ids[0]), int(ids[-1]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) if k == "file_name" else pa.array(v) for k, v in found.items()], list(found))

    span = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return span.mapInArrow(run, ROWS)


def image(start: int, stop: int, record_size: int = 1024) -> bytes:
    """The on-disk bytes of the records."""
    return ntfs.encode(rows(start, stop), record_size)
