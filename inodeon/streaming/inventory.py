"""A live inventory: a scan, and a stream that keeps the last change of every record as state.

The state is a streaming aggregate, the greatest (usn, fields) of each drive's record, so that it combines before the shuffle and stays in the
engine; it is cut into few parts, as each costs some files a batch, whatever it holds. Entries that arrive again or late change nothing. It is checkpointed with the stream's offsets, and the inventory at any moment is the scan with
what the state store says of its last committed batch: there is no second copy to keep in step. Records that are deleted stay in the state, so that older
entries can't bring them back.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inodeon.operators import journal
from inodeon.sources import files

KEYS = ("drive", "record_number")
FIELDS = ("usn", "parent_record_number", "file_name", "reason")
#: Parts of the state for each core, if the session's setting isn't less; a state that is there keeps the number that it began with.
PARTS_PER_CORE = 2
_PARTS = "spark.sql.shuffle.partitions"


class LiveInventory:
    """The last changes of records, kept in a folder of their own; another object with the same folder goes on from there."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.checkpoint = f"{folder.rstrip('/')}/state"

    def follow(self, entries: DataFrame, trigger: dict[str, Any] | None = None) -> Any:
        """Starts to fold a stream of entries; the query is the caller's to await or stop."""
        last = entries.groupBy(*KEYS).agg(F.max(F.struct(*FIELDS)).alias("last"))
        writer = last.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.checkpoint)
        session = entries.sparkSession
        whole = session.conf.get(_PARTS)
        # a query takes the session's settings as they are when it starts
        session.conf.set(_PARTS, str(min(int(whole), PARTS_PER_CORE * session.sparkContext.defaultParallelism)))
        try:
            return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
        finally:
            session.conf.set(_PARTS, whole)

    def changes(self) -> DataFrame | None:
        """The last entry of every record that has changed, as of the last committed batch; None before the first."""
        if not files.names(f"{self.checkpoint}/commits", ""):
            return None
        state = self.spark.read.format("statestore").load(self.checkpoint)
        value = state.schema["value"].dataType.names[0]
        return state.select("key.*", f"value.`{value}`.*")

    def records(self, scan: DataFrame) -> DataFrame:
        """The scan (drive, record_number, parent_record_number, file_name and more) as it is now."""
        found = self.changes()
        return scan if found is None else journal.apply_changes(scan, found, *KEYS)
