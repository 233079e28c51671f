"""Snapshot, catch-up and live watch of several drives without gaps.

A session arms each drive's cursor before it scans the drive, reads the journal from there to its end once the scan is done, and then watches from where
that read stopped. All drives are watched by one streaming query, whose offset holds every drive's cursor. What fails on one drive is that drive's
fault: its cursor stays where it was, its subscribers are told, and the others go on. The session as a whole faults when its query does, or
when no drive is left. Batches are kept in a log, rows and cursors together, and delivered at least once, drive by drive, one
after another; consumers that upsert by (drive, usn) see each change once.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields
from decimal import Decimal
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from inodeon.functions.text import SEPARATOR
from inodeon.model import CURSORS, JournalError, ScanProfile, SessionState
from inodeon.operators import match, paths
from inodeon.sources import mft, usn_journal
from inodeon.streaming.batchlog import BatchLog, Committed, Cursor

Deliver = Callable[[str, DataFrame, Cursor], None]
#: What a scan keeps of the records that it reads.
SCANNED = ("record_number", "parent_record_number", "flags", "is_directory", "file_attributes", "file_name")
#: Drives that are scanned at once, so that one's small steps leave no cores idle.
SCANS = 2


def drive_key(drive: str) -> str:
    return drive.rstrip(":" + SEPARATOR + "/").upper()


@dataclass(frozen=True)
class Drive:
    """Where a drive's records and journal are kept."""

    letter: str
    image: str
    journal: str
    profile: ScanProfile = ScanProfile.FULL
    layout: str = "image"


@dataclass
class ScanResult:
    """Per drive: inventory, entries caught up with, cursors armed and advanced, errors."""

    scans: dict[str, DataFrame] = field(default_factory=dict)
    entries: dict[str, DataFrame] = field(default_factory=dict)
    armed: dict[str, Cursor] = field(default_factory=dict)
    advanced: dict[str, Cursor] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def records(self) -> DataFrame | None:
        """All drives' inventories, with their drive."""
        out = None
        for key, scan in self.scans.items():
            own = scan.withColumn("drive", F.lit(key))
            out = own if out is None else out.unionByName(own)
        return out

    def cursors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, Decimal(journal), usn) for k, (journal, usn) in self.advanced.items()], CURSORS)


class _Faults(StreamingQueryListener):
    """Latches the fault of a session's stream as soon as it ends, whether or not somebody waits for it."""

    def __init__(self, session: WatchSession) -> None:
        self.session = session

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception and str(event.id) in self.session.query_ids:
            self.session.latch(RuntimeError(event.exception))


class WatchSession:
    """Parked until watched, parked again when stopped; a fault of the whole session or disposal ends it.

    Checkpoints and logs are kept in a folder of the session's own, so that another session with the same folder goes on from
    the cursors it is given and not from what this one had read. ``faults`` has the drives that have failed.
    """

    def __init__(self, spark: SparkSession, checkpoint_dir: str) -> None:
        self.spark = spark
        self.checkpoint_dir = f"{checkpoint_dir.rstrip('/')}/session-{uuid.uuid4().hex}"
        self.state = SessionState.PARKED
        self.latest: ScanResult | None = None
        self.cursors: dict[str, Cursor] = {}
        self.fault: BaseException | None = None
        self._drives: dict[str, Drive] = {}
        self._keep: tuple[str, ...] = ()
        self.faults: dict[str, BaseException] = {}
        self._query: Any = None
        self._watched: set[str] = set()
        self._drains = False
        self._faulted: list[Callable[[BaseException], None]] = []
        self._drive_faulted: list[Callable[[str, BaseException], None]] = []
        self._lock = threading.RLock()
        self._logs: list[BatchLog] = []
        self.query_ids: set[str] = set()
        self._listener = _Faults(self)
        spark.streams.addListener(self._listener)

    def _need(self, *states: SessionState) -> None:
        if self.state not in states:
            raise RuntimeError(f"the session is {self.state.value}")

    def start(self, drives: list[Drive], keep: tuple[str, ...] = ()) -> ScanResult:
        """Arm, scan and catch up; drives that fail are in ``errors``."""
        with self._lock:
            self._need(SessionState.PARKED)
            known = {drive_key(d.letter): d for d in drives}
            result = self._scan(known, tuple(keep))
            if known and not result.advanced:  # nothing to go on with: what was known before stays
                raise RuntimeError("; ".join(f"{k}: {e}" for k, e in result.errors.items()))
            self._drives, self._keep = known, tuple(keep)
            self.latest, self.cursors, self.faults = result, dict(result.advanced), {}
            return result

    def warm_start(self, drives: list[Drive], cursors: dict[str, Cursor]) -> None:
        """No scan: watch goes on from known cursors."""
        with self._lock:
            self._need(SessionState.PARKED)
            self._drives = {drive_key(d.letter): d for d in drives}
            self.cursors, self.faults = {drive_key(k): c for k, c in cursors.items()}, {}

    def rescan(self, drives: list[Drive] | None = None, keep: tuple[str, ...] | None = None) -> ScanResult:
        """Another start; arguments left out are those of the last one."""
        return self.start(list(self._drives.values()) if drives is None else drives, self._keep if keep is None else keep)

    def _scan(self, drives: dict[str, Drive], keep: tuple[str, ...]) -> ScanResult:
        result = ScanResult()
        with ThreadPoolExecutor(SCANS) as pool:
            waiting = {key: pool.submit(inheritable_thread_target(self.spark)(self._scan_drive), key, drive, keep) for key, drive in drives.items()}
        for key, found in waiting.items():
            own = found.result()
            for kept, of_drive in ((getattr(result, f.name), getattr(own, f.name)) for f in fields(ScanResult)):
                kept.update(of_drive)
        return result

    def _scan_drive(self, key: str, drive: Drive, keep: tuple[str, ...]) -> ScanResult:
        result = ScanResult()
        try:
            result.armed[key] = usn_journal.query_cursor(drive.journal)
            rows = mft.read_image(self.spark, drive.image, drive=key, layout=drive.layout).select(*SCANNED)
            kept = match.keep_profile(rows, drive.profile, keep)
            scan = match.inventory(paths.resolve_paths(kept, rows, drive=key))
            result.scans[key] = paths.checkpointed(scan)  # read now: the journal is caught up with after the scan
            journal, end = usn_journal.query_cursor(drive.journal)
            entries = usn_journal.read_journal(self.spark, drive.journal, result.armed[key][1], result.armed[key][0], key)
            result.entries[key] = entries.where(F.col("usn") < end)
            result.advanced[key] = (journal, end)
        except Exception as e:  # noqa: BLE001 - one drive's failure is that drive's result
            result.errors[key] = str(e)
        return result

    def watch(self, deliver: Deliver | None = None, trigger: dict[str, Any] | None = None, max_usn: int = 0) -> None:
        """One stream of all drives that haven't failed, from their cursors; ``deliver(drive, entries, cursor)`` for each drive of a batch.

        Deliveries come one after another, after the batch is committed to the session's log; what ``deliver`` raises is that drive's fault.
        Entries of a batch span at most ``max_usn`` USNs of each drive if given, also with the trigger ``availableNow``.
        """
        with self._lock:
            self._need(SessionState.PARKED)
            if not self.cursors:
                raise RuntimeError("No drives to watch")
            given = {k: (self._drives[k].journal, *c) for k, c in self.cursors.items() if k not in self.faults}
            for key, (folder, journal, usn) in list(given.items()):
                if journal == 0:  # from the journal's end
                    try:
                        given[key] = (folder, *usn_journal.query_cursor(folder))
                    except (JournalError, OSError) as e:
                        del given[key]
                        self.latch_drive(key, e)
            if not given:
                raise self.fault or RuntimeError("No drives to watch")
            place = f"{self.checkpoint_dir}/run-{len(self._logs)}"
            log = BatchLog(self.spark, f"{place}/log")
            stream = usn_journal.stream_drives(self.spark, given, f"{place}/position.json", max_usn)
            self._watched, self._logs = set(given), [*self._logs, log]
            # Spark asks a source once with availableNow; bounded batches are drained instead
            self._drains = bool(max_usn and (trigger or {}).get("availableNow"))
            trigger = {"processingTime": "0 seconds"} if self._drains else trigger or {"processingTime": "1 second"}
            each = lambda batch, number: self._each(log, batch, number, deliver)
            self.state = SessionState.WATCHING
            try:
                self._query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{place}/checkpoint").trigger(**trigger).start()
            except Exception:
                self.state = SessionState.PARKED
                raise
            self.query_ids.add(str(self._query.id))
            if self._query.exception():  # what ended before its id was known
                self.latch(self._query.exception())

    def _each(self, log: BatchLog, batch: DataFrame, number: int, deliver: Deliver | None) -> None:
        done = log.commit(number, batch)
        for key, message in done.errors.items():
            self.latch_drive(key, JournalError(message))
        rows = log.rows([done]) if deliver else None
        for key, cursor in done.cursors.items():
            if key in self.faults and key not in done.errors:
                continue
            try:
                if deliver:
                    deliver(key, rows.where(F.col("drive") == key), (cursor[0], cursor[1]))
            except Exception as e:  # noqa: BLE001 - a consumer of one drive
                self.latch_drive(key, e)
                continue
            if key not in self.faults:
                self.cursors[key] = (cursor[0], cursor[1])

    def batches(self) -> list[Committed]:
        """What has been committed so far, in order."""
        return [b for log in self._logs for b in log.batches()]

    def delivered(self, drive: str) -> DataFrame | None:
        """What has been committed of a drive so far, whenever it is asked for; a fault of the drive or of the session is raised."""
        key = drive_key(drive)
        if key in self.faults or self.fault:
            raise self.faults.get(key) or self.fault
        return self.kept(drive)

    def kept(self, drive: str | None = None) -> DataFrame | None:
        """The same without raising, of a drive that has failed what came before; of all drives if none is given."""
        out = None
        for log in self._logs:
            rows = log.rows(drive=drive and drive_key(drive))
            out = rows if out is None or rows is None else out.unionByName(rows)
        return out

    def _end_streams(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def query(self, drive: str) -> Any:
        """The streaming query that watches a drive."""
        self._need(SessionState.WATCHING)
        if drive_key(drive) not in self._watched:
            raise ValueError(f"drive {drive} is not watched")
        return self._query

    def await_end(self, timeout: float | None = None) -> None:
        """Waits for the stream (with a trigger that ends) or for the timeout; a fault of the session is raised, those of drives are in ``faults``."""
        try:
            if self._query is not None and self._drains:
                usn_journal.drain(self._query)
            elif self._query is not None:
                self._query.awaitTermination(timeout)
        except Exception as e:  # noqa: BLE001 - kept for subscribers that come later
            self.latch(e)
        if self.fault:
            raise self.fault

    def on_drive_fault(self, call: Callable[[str, BaseException], None]) -> None:
        """Called with a drive and its fault, at once for those that are there already."""
        with self._lock:
            self._drive_faulted.append(call)
            for key, e in self.faults.items():
                call(key, e)

    def latch_drive(self, key: str, e: BaseException) -> None:
        """Keeps a drive's first fault; when no watched drive is left, it is the session's."""
        with self._lock:
            if key in self.faults or self.state is SessionState.DISPOSED:
                return
            self.faults[key] = e
            for call in self._drive_faulted:
                call(key, e)
            if self.cursors.keys() <= self.faults.keys():
                self.latch(e)

    def on_fault(self, call: Callable[[BaseException], None]) -> None:
        """Called once, at once if the fault is there already."""
        with self._lock:
            self._faulted.append(call)
            if self.fault:
                call(self.fault)

    def latch(self, e: BaseException) -> None:
        """Keeps the first fault, for subscribers that come later too."""
        with self._lock:
            if self.fault is None and self.state is not SessionState.DISPOSED:
                self.fault, self.state = e, SessionState.FAULTED
                for call in self._faulted:
                    call(e)

    def stop(self) -> dict[str, Cursor]:
        """Ends the stream; the cursors of all drives, of failed ones where they stood, are where the next watch goes on."""
        self._need(SessionState.WATCHING, SessionState.FAULTED)
        self._end_streams()  # without the lock, which a batch that is under way may need
        with self._lock:
            if self.state is SessionState.WATCHING:
                self.state = SessionState.PARKED
            return dict(self.cursors)

    def dispose(self) -> None:
        self._end_streams()
        with self._lock:
            if self.state is not SessionState.DISPOSED:
                self.spark.streams.removeListener(self._listener)
            self.state = SessionState.DISPOSED
