"""Rows and cursors of a stream's batches, committed together.

A batch is written under a name of its own and becomes part of the log when its manifest, which names the rows and every drive's cursor behind
them, is renamed into place. Readers see batches with a manifest only, and a batch that comes again finds its manifest and isn't written twice; so
each row is there once, whatever is killed when. What was written without a manifest is nobody's and may be cleared.

Every ``COMPACT``-th manifest also holds what the earlier ones say, so that a reader opens a bounded number of files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inodeon.sources import files

Cursor = tuple[int, int]
COMPACT = 64


@dataclass
class Committed:
    """A batch of the log: where its rows are, and by drive the number of rows, the cursor, and the error if it failed."""

    number: int
    path: str
    entries: dict[str, int] = field(default_factory=dict)
    cursors: dict[str, list[int]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


class BatchLog:
    """The log in a folder; many drives share it. A task's file holds few drives, so that its statistics say whether one of them is in it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/manifest/{number:020d}.json"

    def _read(self, number: int) -> dict:
        path = self._manifest(number)
        return json.loads(files.read_range(path, 0, files.size(path)))

    def batches(self) -> list[Committed]:
        """The committed batches in order."""
        numbers = [int(n.removesuffix(".json")) for n in files.names(f"{self.folder}/manifest", ".json")]
        compact = max((n for n in numbers if n % COMPACT == COMPACT - 1), default=-1)
        found = self._read(compact)["earlier"] if compact >= 0 else []
        found += [self._read(n)["batch"] for n in numbers if n >= compact]
        return [Committed(**b) for b in found]

    def commit(self, number: int, rows: DataFrame) -> Committed:
        """The batch ``number`` with its rows, each of which has a drive, and an ``error`` or the fields of an entry."""
        if files.exists(self._manifest(number)):
            return Committed(**self._read(number)["batch"])
        batch = Committed(number, f"{self.folder}/rows/{number:020d}-{uuid.uuid4().hex}")
        rows.write.parquet(batch.path)
        kept = self.spark.read.schema(rows.schema).parquet(batch.path)
        ends = kept.groupBy("drive").agg(F.count("usn").alias("n"), F.max("usn").alias("usn"), F.max("journal_id").alias("journal_id"), F.max("error").alias("error"))
        for r in ends.collect():  # a row a drive
            if r["n"]:
                batch.entries[r["drive"]] = r["n"]
                batch.cursors[r["drive"]] = [int(r["journal_id"]), r["usn"] + 1]
            if r["error"]:
                batch.errors[r["drive"]] = r["error"]
        earlier = {"earlier": [asdict(b) for b in self.batches()]} if number % COMPACT == COMPACT - 1 else {}
        own = f"{self._manifest(number)}.{uuid.uuid4().hex}.tmp"
        with files.create(own) as out:
            out.write(json.dumps({"batch": asdict(batch)} | earlier).encode())
        files.rename(own, self._manifest(number))
        return batch

    def rows(self, batches: list[Committed] | None = None, drive: str | None = None) -> DataFrame | None:
        """The entries of committed batches, of one drive if given; None if there are none."""
        known = self.batches() if batches is None else batches
        paths = [b.path for b in known if (drive in b.entries if drive else b.entries)]
        if not paths:
            return None
        found = self.spark.read.parquet(*paths).where("error is null").drop("error")
        return found.where(F.col("drive") == drive) if drive else found

    def cursors(self) -> dict[str, Cursor]:
        """Where each drive's next read begins, as its last committed batch says."""
        found: dict[str, Cursor] = {}
        for b in self.batches():
            found |= {k: (c[0], c[1]) for k, c in b.cursors.items()}
        return found

    def errors(self) -> dict[str, str]:
        """By drive what it failed of."""
        found: dict[str, str] = {}
        for b in self.batches():
            found = b.errors | found
        return found
