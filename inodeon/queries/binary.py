"""Queries over binary images, journals and payloads that are written first and read back through the data sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inodeon.functions.flags import timestamp_to_filetime
from inodeon.model import MatchFlags, ScanProfile
from inodeon.operators import match, paths
from inodeon.plans.virtual import JRN_SQL, PATHS_SQL, VOL_SQL, journal, read, volume
from inodeon.sources import files, frames, mft, ntfs, scan_payload, synthetic, usn_journal
from inodeon.streaming.batchlog import BatchLog
from inodeon.streaming.inventory import LiveInventory
from inodeon.streaming.session import Drive, WatchSession

Query = Callable[[SparkSession, str], DataFrame]
#: Entries of a journal segment, and every so many-th record that has a torn sector.
SEGMENT = 2000
TORN = 7
JOURNAL_ID = 43981
DRIVES = 200


def _folder(spark: SparkSession, name: str) -> str:
    return f"{paths.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _image(spark: SparkSession, sf_dir: str, **options: object) -> str:
    """A synthetic image with as many records as there are orders, written and read in parts."""
    path = _folder(spark, "image")
    mft.write_image(spark, path, read(spark, sf_dir, "orders").count(), **options)
    return path


# The generator in SQL: 128-bit integers, cut back to 64 bits after each step; u1, u2, u3 are the first three draws.
_M = "18446744073709551616::HUGEINT"


def _draw(source: str, to: str) -> str:
    names = "i, " + "".join(f"{c}, " for c in ("u1", "u2")[: int(to[1:]) - 1])
    shift = lambda x, k: f"xor({x}, ({x} * {k}::HUGEINT) % {_M})"
    a, b, c = f"{to}a", f"{to}b", f"{to}c"
    return (
        f"{a} AS (SELECT {names}{shift('x', 8192)} AS x FROM {source}), {b} AS (SELECT {names}xor(x, x // 128::HUGEINT) AS x FROM {a}), "
        f"{c} AS (SELECT {names}{shift('x', 131072)} AS x FROM {b}), {to} AS (SELECT {names}x % 4294967296::HUGEINT AS {'u' + to[1:]}, x FROM {c})"
    )


GENERATOR_SQL = (
    f"d0 AS (SELECT i, xor(12345678901::HUGEINT, ((i::HUGEINT * 6364136223846793005::HUGEINT) % {_M} + 1) % {_M}) AS x FROM (SELECT unnest(range(0, n)) AS i FROM (SELECT count(*) AS n FROM orders))), "
    + ", ".join(_draw(f"d{k - 1}", f"d{k}") for k in (1, 2, 3))
    + ", m AS (SELECT i, (u1 % 100)::BIGINT AS roll, u2, u3 FROM d3)"
)
SYNTH_SQL = f"""
WITH {GENERATOR_SQL}
SELECT count(*) FILTER (WHERE i <= 5 OR roll >= 25) AS used, count(*) FILTER (WHERE i > 5 AND roll < 10) AS zeroed,
       count(*) FILTER (WHERE i > 5 AND roll >= 10 AND roll < 25) AS extensions,
       count(*) FILTER (WHERE i = 5 OR (i > 5 AND roll >= 25 AND roll < 40)) AS directories
FROM m
"""


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


IMAGE_SQL = f"""{GENERATOR_SQL}, image AS (
  SELECT i AS record_number,
         CASE WHEN i < 5 THEN 0 WHEN i < 100 THEN 5 ELSE (u2 % (i // 2))::BIGINT + 5 END AS parent_record_number,
         CASE WHEN i = 5 OR (i > 5 AND roll < 40) THEN 3 ELSE 1 END AS flags,
         CASE WHEN i < 5 THEN '$MFT' WHEN i = 5 THEN '.'
              ELSE (CASE WHEN roll < 40 THEN {_list(synthetic.DIR_NAMES)} ELSE {_list(synthetic.FILE_NAMES)} END)[((CASE WHEN i < 100 THEN u2 ELSE u3 END) % 16)::INTEGER + 1] END AS file_name
  FROM m WHERE i <= 5 OR roll >= 25
)"""


def _attributes_sql() -> str:
    """Up to eleven draws of each record; three of them, after those for parent, name, times and size, decide on the attribute bits."""
    steps = [f"e0 AS (SELECT i, x, []::HUGEINT[] AS xs FROM d0)"]
    shift = lambda k: f"xor(x, (x * {k}::HUGEINT) % {_M})"
    for k in range(1, 12):
        steps.append(f"e{k}a AS (SELECT i, xs, {shift(8192)} AS x FROM e{k - 1}), e{k}b AS (SELECT i, xs, xor(x, x // 128::HUGEINT) AS x FROM e{k}a)")
        steps.append(f"e{k}c AS (SELECT i, xs, {shift(131072)} AS x FROM e{k}b), e{k} AS (SELECT i, x, list_append(xs, x) AS xs FROM e{k}c)")
    d0 = GENERATOR_SQL.partition("), ")[0] + ")"
    assert d0.startswith("d0 AS (")
    return f"""
WITH {d0}, {', '.join(steps)},
kinds AS (SELECT i, xs, (xs[1] % 4294967296::HUGEINT % 100)::BIGINT AS roll FROM e11),
live AS (SELECT i, xs, i > 5 AS named, i = 5 OR (i > 5 AND roll < 40) AS folder FROM kinds WHERE i <= 5 OR roll >= 25),
placed AS (SELECT i, xs, folder, (1 + (named AND i >= 100)::INTEGER + named::INTEGER + 4 + (NOT folder)::INTEGER)::INTEGER AS k FROM live)
SELECT i AS record_number, (CASE WHEN folder THEN 16 ELSE 32 END + CASE WHEN xs[k + 1] % 20 = 0 THEN 2 ELSE 0 END
  + CASE WHEN xs[k + 2] % 50 = 0 THEN 4 ELSE 0 END + CASE WHEN xs[k + 3] % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS file_attributes
FROM placed
"""


ATTRIBUTES_SQL = _attributes_sql()


def s21_synth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.records(spark, read(spark, sf_dir, "orders").count())
    live = ~F.col("zeroed") & (F.col("base_reference") == 0)
    return rows.agg(
        F.count_if(live).alias("used"),
        F.count_if("zeroed").alias("zeroed"),
        F.count_if(F.col("base_reference") > 0).alias("extensions"),
        F.count_if(live & (F.col("flags").bitwiseAND(2) != 0)).alias("directories"),
    )


def s05_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mft.read_image(spark, _image(spark, sf_dir), recordsPerPartition=3000).select("record_number", "parent_record_number", "flags", "file_name", "fixup_ok")


def s08_fixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records by whether their sectors are whole; every seventh record of the image was torn."""
    rows = mft.read_image(spark, _image(spark, sf_dir, tornEvery=TORN))
    return rows.groupBy((F.col("record_number") % 10).alias("digit"), "fixup_ok").agg(F.count("*").alias("n"), F.max("record_number").alias("last"))


def r06_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search for a name finds, and what the very scan that it ran came to; times differ from run to run, so only their presence is compared."""
    rows, seen = mft.measured_image(spark, _image(spark, sf_dir), recordsPerPartition=4096)
    found = match.find_by_name(rows, ".git").groupBy("parent_record_number").agg(F.count("*").alias("n")).agg(F.sum("n").alias("found"), F.count("*").alias("parents"))
    found = paths.checkpointed(found)
    totals = seen.get
    timed = all(totals[k] > 0 for k in ("io_ms", "fixup_ms", "parse_ms"))
    return found.select(*(F.lit(totals[k]).cast("long").alias(k) for k in ("total_records", "used_records", "bytes")), "found", "parents", F.lit(timed).alias("timed"))


def s04_volume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume: boot sector, table in runs out of order, some of which only an extension record names."""
    path = _folder(spark, "volume") + "/disk.img"
    mft.write_volume(path, read(spark, sf_dir, "customer").count())
    rows = mft.read_image(spark, path, layout="volume", recordsPerPartition=100)
    return rows.select("record_number", "parent_record_number", "flags", "file_name", "fixup_ok")


def _skipping(spark: SparkSession, sf_dir: str, text: str, flags: MatchFlags) -> DataFrame:
    """What a search finds in an image of the volume with an index of names, and whether less than half of the slots were read for it."""
    path = _folder(spark, "indexed")
    mft.write_records(spark, volume(spark, sf_dir), path, 2048)
    mft.index_names(spark, path, 128)
    found, seen = mft.search_image(spark, path, text, flags)
    found = paths.checkpointed(found.select("record_number", "parent_record_number", "file_name"))
    slots = mft.slots_of(path)
    return found.withColumn("skipped", F.lit(2 * seen.get["total_records"] < slots))


def p08_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skipping(spark, sf_dir, "order#1003", MatchFlags.EXACT)


def p09_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skipping(spark, sf_dir, "mer#0000000", MatchFlags.CONTAINS)


def s12_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered records of a volume in several runs, by number; some numbers are beyond its end."""
    path = _folder(spark, "volume") + "/disk.img"
    n = read(spark, sf_dir, "customer").count()
    mft.write_volume(path, n)
    wanted = read(spark, sf_dir, "orders").select((F.col("o_custkey").cast("long") * 7 % (2 * n)).alias("record_number"))
    return mft.point_reads(spark, wanted, path, layout="volume").select("record_number", "parent_record_number", "flags", "file_name", "fixup_ok")


def a09_live_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume with the changes of a stream in two runs, each entry arriving twice."""
    folder, live = _folder(spark, "journal"), LiveInventory(spark, _folder(spark, "live"))
    half = journal(spark, sf_dir).agg(F.expr("max(usn) div 2")).first()[0]
    for part in (f"usn <= {half}", f"usn > {half}"):
        _written_journal(spark, sf_dir, part, folder)
        again = [usn_journal.stream_journal(spark, folder, journal_id=JOURNAL_ID, drive="C") for _ in range(2)]
        live.follow(again[0].unionByName(again[1]), {"availableNow": True}).awaitTermination()
    return live.records(volume(spark, sf_dir).withColumn("drive", F.lit("C"))).select("record_number", "file_name", "parent_record_number")


def p05_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the live records, from their standard information."""
    return mft.read_image(spark, _image(spark, sf_dir)).select("record_number", "file_attributes")


def p22_utf16_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names laid end to end as UTF-16 units, some beyond ASCII and beyond 16 bits, and read back with their ASCII letters folded."""
    tail = F.element_at(F.array(F.lit(""), F.lit("\u00dcn\u00efx"), F.lit("\U0001f600")), (F.col("c_custkey") % 3 + 1).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = ntfs.units_of(batch.column(1))
            lengths = np.diff(np.r_[0, ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), ntfs.strings(np.frombuffer(raw, dtype="<u2"), lengths), pa.array(lengths)], ["c_custkey", "name", "units"])

    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.concat("c_name", tail).alias("name"))
    return rows.mapInArrow(run, "c_custkey long, name string, units long")


def u13_late_subscriber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drives' changes are kept by drive; who asks for one of them after the watch gets them all."""
    letters = {"C": "record_number % 2 = 0", "D": "record_number % 2 = 1"}
    folders = {k: _written_journal(spark, sf_dir, w) for k, w in letters.items()}
    session = WatchSession(spark, _folder(spark, "late"))
    try:
        session.warm_start([Drive(k, "", f) for k, f in folders.items()], {k: (JOURNAL_ID, 0) for k in folders})
        session.watch(trigger={"availableNow": True})
        session.await_end()
        return session.delivered("d:").select("drive", "usn", "record_number")
    finally:
        session.dispose()


def u16_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan with the drives of the first: its cursor is behind what came in between, and its inventory has the directories."""
    half = journal(spark, sf_dir).agg(F.expr("max(usn) div 2")).first()[0]
    folder = _written_journal(spark, sf_dir, f"usn <= {half}")
    session = WatchSession(spark, _folder(spark, "rescan"))
    try:
        session.start([Drive("C", _image(spark, sf_dir), folder, ScanProfile.DIRECTORY_INDEX)])
        first = session.cursors["C"][1]
        _written_journal(spark, sf_dir, f"usn > {half}", folder)
        found = session.rescan()
        counts = found.records.groupBy("drive").agg(F.count("*").alias("directories"))
        return counts.withColumns({"first_usn": F.lit(first).cast("long"), "next_usn": F.lit(found.advanced["C"][1]).cast("long")})
    finally:
        session.dispose()


def u17_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors kept in a table start a session without a scan; it watches from there."""
    out, folder = _folder(spark, "warm"), _written_journal(spark, sf_dir)
    half = journal(spark, sf_dir).agg(F.expr("max(usn) div 2")).first()[0]
    spark.range(1).select(F.lit("c:\\").alias("drive"), F.lit(JOURNAL_ID).cast("decimal(20,0)").alias("journal_id"), F.lit(half).cast("long").alias("next_usn")).write.parquet(f"{out}/cursors")
    kept = {r.drive: (int(r.journal_id), r.next_usn) for r in spark.read.parquet(f"{out}/cursors").collect()}
    session = WatchSession(spark, out)
    try:
        session.warm_start([Drive("C", "", folder)], kept)
        session.watch(lambda key, batch, cursor: batch.select("drive", "usn", F.lit(cursor[1]).alias("next_usn")).write.mode("append").parquet(f"{out}/rows"), {"availableNow": True})
        session.await_end()
    finally:
        session.dispose()
    return spark.read.parquet(f"{out}/rows")


def s22_skip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image whose files have a prefix of 20 bytes, found by looking."""
    path = _folder(spark, "prefixed")
    mft.write_image(spark, path, read(spark, sf_dir, "supplier").count(), prefix=True)
    return mft.read_image(spark, path, skipPrefix="auto").select("record_number", "file_name")


def s09_data_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lists of non-resident attributes, one for each order: a first run, and one a little before it."""
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    cluster = F.col("o_custkey") % 4_000_000
    head = "80000000" + "50000000" + "01" + "00" * 23 + "4000" + "00" * 30  # type, length, not resident, place of the runs
    first = F.concat(F.lit("31"), byte(F.col("o_orderkey") % 200 + 1), *(byte(F.shiftright(cluster.cast("long"), k).bitwiseAND(F.lit(255))) for k in (0, 8, 16)))
    second = F.concat(F.lit("1107"), byte(255 - F.col("o_orderkey") % 100), F.lit("00"))
    attributes = read(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.concat(F.lit(head), first, second)).alias("attribute"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ntfs.data_runs(raw, 0) for raw in batch.column(1).to_pylist()]
            flat = [(key, k + 1, *one) for key, runs in zip(batch.column(0).to_pylist(), found) for k, one in enumerate(runs)]
            columns = list(zip(*flat)) if flat else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.bool_()))], ["o_orderkey", "position", "cluster", "clusters", "sparse"])

    return attributes.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "attribute").mapInArrow(run, "o_orderkey long, position long, cluster long, clusters long, sparse boolean")


def p01_live_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base records in use with a name, out of all slots."""
    rows = synthetic.records(spark, read(spark, sf_dir, "orders").count()).withColumn("magic_ok", ~F.col("zeroed"))
    return match.live_records(rows).select("record_number", "file_name")


def p17_image_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mft.read_image(spark, _image(spark, sf_dir))
    return match.find_by_name(rows, ".git", MatchFlags.EXACT | MatchFlags.RESOLVE_PATHS).select("record_number", "full_path")


def h02_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mft.read_image(spark, _image(spark, sf_dir))
    return paths.resolve_paths(rows, rows, plan="doubling").select("record_number", "full_path")


def _written_journal(spark: SparkSession, sf_dir: str, where: str = "true", folder: str = "") -> str:
    """The virtual journal, or a part of it, as segment files, written by tasks; one task a segment."""
    return _written_journals(spark, sf_dir, F.lit(""), where, folder)


def _written_journals(spark: SparkSession, sf_dir: str, drive: F.Column, where: str = "true", folder: str = "", drives: int = 1) -> str:
    """The same in a folder of each drive's own below one folder, all drives by one job; with so many ``drives`` a segment spans as many times the USNs."""
    width = SEGMENT * drives
    folder = folder or _folder(spark, "journal")
    rows = journal(spark, sf_dir).where(where).select("usn", "record_number", "parent_record_number", timestamp_to_filetime(F.col("ts").cast("timestamp")).alias("filetime"), "reason", F.lit(32).cast("long").alias("file_attributes"), "file_name")

    def write(entries: pa.Table) -> pa.Table:
        entries = entries.sort_by("usn")
        first, usn = entries.column("segment")[0].as_py() * width, entries.column("usn")
        usn_journal.append_segment(f"{folder}/{entries.column('drive')[0].as_py()}", JOURNAL_ID, max(first, usn[0].as_py()), usn[-1].as_py() + 1, entries)
        return entries.select(["segment"]).slice(0, 1)

    rows.withColumns({"segment": F.expr(f"usn div {width}"), "drive": drive}).groupBy("drive", "segment").applyInArrow(write, "segment long").count()
    return folder


def s17_journal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usn_journal.read_journal(spark, _written_journal(spark, sf_dir), drive="C")
    return found.select("drive", F.col("journal_id").cast("long").alias("journal_id"), "usn", "record_number", "parent_record_number", "filetime", "reason", "file_name")


def s16_journal_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usn_journal.read_journal(spark, _written_journal(spark, sf_dir), start=500, journal_id=43981)
    return found.select("usn", "record_number", "reason")


def s15_journal_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal_id, usn = usn_journal.query_cursor(_written_journal(spark, sf_dir))
    return spark.createDataFrame([(journal_id, usn)], "journal_id long, next_usn long")


def u07_journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a stream, all that is there, into a table."""
    out = _folder(spark, "stream")
    stream = usn_journal.stream_journal(spark, _written_journal(spark, sf_dir), start=500, journal_id=43981)
    query = stream.writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out + "/rows").select("usn", "record_number", "reason")


def k01_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = volume(spark, sf_dir)
    path = _folder(spark, "payload")
    scan_payload.write(match.inventory(paths.resolve_paths(rows, rows, drive="C", plan="doubling")), path)
    return scan_payload.read(spark, path).withColumn("size", F.col("size").cast("long"))


def u08_stream_with_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a stream in two runs: each batch with its cursor, the second from where the first one's checkpoint stands."""
    folder, out = _folder(spark, "journal"), _folder(spark, "stream")
    half = journal(spark, sf_dir).agg(F.expr("max(usn) div 2")).first()[0]

    def put(batch: DataFrame, number: int) -> None:
        found = batch.agg(F.count("*").alias("n_entries"), (F.max("usn") + 1).alias("next_usn")).where("n_entries > 0")
        found.select(F.lit(number).cast("long").alias("batch"), "n_entries", "next_usn").write.mode("append").parquet(f"{out}/rows")

    for part in (f"usn <= {half}", f"usn > {half}"):
        _written_journal(spark, sf_dir, part, folder)
        stream = usn_journal.stream_journal(spark, folder, journal_id=JOURNAL_ID).writeStream.foreachBatch(put)
        stream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def u11_session_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drives are armed, scanned and watched: what comes after the scan is delivered once, by drive."""
    image, out = _image(spark, sf_dir), _folder(spark, "delivered")
    half = journal(spark, sf_dir).agg(F.expr("max(usn) div 2")).first()[0]
    letters, key = "CD", F.when(F.col("record_number") % 2 == 0, "C").otherwise("D")
    folder = _written_journals(spark, sf_dir, key, f"usn <= {half}")
    session = WatchSession(spark, out)
    try:
        session.start([Drive(k, image, f"{folder}/{k}", ScanProfile.DIRECTORY_INDEX) for k in letters])
        _written_journals(spark, sf_dir, key, f"usn > {half}", folder)
        session.watch(lambda key, batch, cursor: batch.select("drive", "usn", "record_number", "file_name").write.mode("append").parquet(f"{out}/rows/{key}"), {"availableNow": True})
        session.await_end()
    finally:
        session.dispose()
    return spark.read.parquet(*(f"{out}/rows/{k}" for k in letters))


def u14_many_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred drives in one stream of bounded batches: one fails at once, one after its first batch, one after its second; all others are read whole."""
    step = journal(spark, sf_dir).agg(F.expr("max(usn) div 4")).first()[0]
    key = F.concat(F.lit("D"), F.lpad((F.col("record_number") % DRIVES).cast("string"), 3, "0"))
    folder = _written_journals(spark, sf_dir, key, drives=DRIVES)
    drives = {f"D{i:03d}": (JOURNAL_ID - (i == 7), 0) for i in range(DRIVES)}
    session = WatchSession(spark, _folder(spark, "many"))

    def deliver(drive: str, batch: DataFrame, cursor: tuple[int, int]) -> None:
        seen[drive] = seen.get(drive, 0) + 1
        if drive == "D050" and seen[drive] == 1:  # its journal begins to be deleted
            with files.create(f"{folder}/{drive}/{JOURNAL_ID}.deleting"):
                pass
        if drive == "D120" and seen[drive] == 2:  # its journal is created anew
            usn_journal.append_segment(f"{folder}/{drive}", JOURNAL_ID + 1, 0, 1, [(6, 5, 0, 1, 2, 0, "x")])

    seen: dict[str, int] = {}
    try:
        session.warm_start([Drive(k, "", f"{folder}/{k}") for k in drives], drives)
        session.watch(deliver, {"availableNow": True}, max_usn=step)
        session.await_end()
        counts = session.kept().groupBy("drive").agg(F.count("*").alias("n_entries"), (F.max("usn") + 1).alias("next_usn"))
        failed = spark.createDataFrame([(k, str(e).partition(":")[0]) for k, e in session.faults.items()], "drive string, message string")
        return counts.join(failed, "drive", "full").select("drive", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "next_usn", "message")
    finally:
        session.dispose()


def u07_bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal in batches of bounded size, in two runs: the first one dies in its third batch, the second goes on from the checkpoint."""
    out, folder = _folder(spark, "bounded"), _written_journal(spark, sf_dir)
    step = journal(spark, sf_dir).agg(F.expr("max(usn) div 7 + 1")).first()[0]

    def put(batch: DataFrame, number: int) -> None:
        if number == 2 and not died:
            died.append(number)
            raise RuntimeError("killed")
        ends = batch.agg(F.count("*").alias("n_entries"), F.min("usn").alias("first_usn"), (F.max("usn") + 1).alias("next_usn")).where("n_entries > 0")
        ends.select(F.lit(number).cast("long").alias("batch"), "n_entries", "first_usn", "next_usn").write.mode("overwrite").parquet(f"{out}/rows/{number}")

    died: list[int] = []
    for _ in range(2):
        stream = usn_journal.stream_journal(spark, folder, 1, JOURNAL_ID, max_usn=step, position=f"{out}/position.json")
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="0 seconds").start()
        try:
            usn_journal.drain(query)
        except StreamingQueryException:
            pass
    return spark.read.option("recursiveFileLookup", True).parquet(f"{out}/rows")


def k05_committed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cursors of two drives in one log: a batch that was committed is repeated after a crash, one that was half written too; each row is there once."""
    out = _folder(spark, "log")
    key = F.when(F.col("record_number") % 2 == 0, "C").otherwise("D")
    folder = _written_journals(spark, sf_dir, key)
    step = journal(spark, sf_dir).agg(F.expr("max(usn) div 5 + 1")).first()[0]
    drives = {k: (f"{folder}/{k}", JOURNAL_ID, 0) for k in "CD"}
    log = BatchLog(spark, f"{out}/log")

    def put(batch: DataFrame, number: int) -> None:
        if number == 1 and len(died) == 0:  # rows without a manifest
            died.append(number)
            batch.write.parquet(f"{out}/log/rows/{number:020d}-half")
            raise RuntimeError("killed")
        log.commit(number, batch)
        if number == 2 and len(died) == 1:  # a manifest, but Spark doesn't know yet
            died.append(number)
            raise RuntimeError("killed")

    died: list[int] = []
    for _ in range(3):
        stream = usn_journal.stream_drives(spark, drives, f"{out}/position.json", step)
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="0 seconds").start()
        try:
            usn_journal.drain(query)
        except StreamingQueryException:
            pass
    again = BatchLog(spark, f"{out}/log")  # nothing is kept in the driver's memory
    cursors = spark.createDataFrame([(k, usn) for k, (_, usn) in again.cursors().items()], "drive string, cursor long")
    return again.rows().select("drive", "usn", "record_number", "file_name").join(F.broadcast(cursors), "drive")


def s17_split_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of the journal is cut into ranges of 4 KB for different tasks; if there are many, each task has some."""
    found = usn_journal.read_journal(spark, _written_journal(spark, sf_dir), drive="C", range_bytes=4096)
    return found.select("drive", F.col("journal_id").cast("long").alias("journal_id"), "usn", "record_number", "parent_record_number", "filetime", "reason", "file_name")


def u12_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six drives: of one the journal's beginning is gone, one has none, one was created anew and one is being deleted.

    These have a message, the others their entries.
    """
    half = journal(spark, sf_dir).agg(F.expr("max(usn) div 2")).first()[0]
    drives = {}
    for i, letter in enumerate("CDEFGH"):
        where = f"record_number % 6 = {i}" + (f" and usn >= {half}" if letter == "D" else "")
        folder = _written_journal(spark, sf_dir, where) if letter != "F" else _folder(spark, "none")
        drives[letter] = (folder, JOURNAL_ID - (letter == "G"), int(letter == "D"))
    with files.create(f"{drives['H'][0]}/{JOURNAL_ID}.deleting"):
        pass
    entries, errors = usn_journal.read_drives(spark, drives)
    read_well = entries.groupBy("drive").agg(F.count("*").alias("n_entries"), F.lit(None).cast("string").alias("message"))
    failed = spark.createDataFrame([(k, 0, m.partition(":")[0]) for k, m in errors.items()], "drive string, n_entries long, message string")
    return read_well.unionByName(failed)


def c02_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's entries packed into batch frames and read back, a hundred to a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for at in range(0, len(rows), 100):
                part = [(*r[:5], 32, r[5]) for r in rows[at : at + 100]]
                raw = frames.write("JournalBatch", drive="C", journal_id=JOURNAL_ID, next_usn=part[-1][2] + 1, entries=part)
                kind, values, size = frames.read(raw + b"\0")
                if kind != "JournalBatch" or size != len(raw):
                    raise frames.InvalidFrame(f"{kind} of {size} bytes")
                columns = list(zip(*values["entries"]))
                names = ("record_number", "parent_record_number", "usn", "filetime", "reason", "attributes", "file_name")
                yield pa.RecordBatch.from_pydict({n: pa.array(list(c), pa.string() if n == "file_name" else pa.int64()) for n, c in zip(names, columns)})

    rows = journal(spark, sf_dir).select("record_number", "parent_record_number", "usn", timestamp_to_filetime(F.col("ts").cast("timestamp")).alias("filetime"), "reason", "file_name")
    return rows.mapInArrow(run, "record_number long, parent_record_number long, usn long, filetime long, reason long, attributes long, file_name string")


QUERIES: dict[str, Query] = {
    "s21_synth_counts": s21_synth_counts,
    "s05_image_scan": s05_image_scan,
    "s08_fixup": s08_fixup,
    "s09_data_runs": s09_data_runs,
    "p01_live_records": p01_live_records,
    "p17_image_scanner": p17_image_scanner,
    "h02_image_paths": h02_image_paths,
    "s17_journal_decode": s17_journal_decode,
    "s16_journal_since": s16_journal_since,
    "s15_journal_cursor": s15_journal_cursor,
    "u07_journal_stream": u07_journal_stream,
    "k01_payload_roundtrip": k01_payload_roundtrip,
    "c02_frames": c02_frames,
    "s04_volume_scan": s04_volume_scan,
    "p05_attributes": p05_attributes,
    "p22_utf16_names": p22_utf16_names,
    "u13_late_subscriber": u13_late_subscriber,
    "u16_rescan": u16_rescan,
    "u17_warm_start": u17_warm_start,
    "r06_timings": r06_timings,
    "s22_skip_prefix": s22_skip_prefix,
    "u08_stream_with_cursor": u08_stream_with_cursor,
    "u11_session_watch": u11_session_watch,
    "u12_error_isolation": u12_error_isolation,
    "u14_many_drives": u14_many_drives,
    "u07_bounded_batches": u07_bounded_batches,
    "k05_committed_batches": k05_committed_batches,
    "s17_split_segment": s17_split_segment,
    "s12_point_reads": s12_point_reads,
    "p08_skipping": p08_skipping,
    "p09_skipping": p09_skipping,
    "a09_live_inventory": a09_live_inventory,
}

_J = f"WITH {JRN_SQL} "
_WALK = f"""WITH RECURSIVE {IMAGE_SQL}, walk AS (
  SELECT record_number AS s, parent_record_number AS cur, [record_number] AS ids, file_name AS path, 1 AS d FROM image WHERE record_number <> 5
  UNION ALL
  SELECT w.s, f.parent_record_number, list_append(w.ids, f.record_number), f.file_name || chr(92) || w.path, w.d + 1
  FROM walk w JOIN image f ON f.record_number = w.cur WHERE f.record_number <> 5 AND NOT list_contains(w.ids, f.record_number)
) """

ORACLE_SQL: dict[str, str] = {
    "s21_synth_counts": SYNTH_SQL,
    "s05_image_scan": f"WITH {IMAGE_SQL} SELECT *, true AS fixup_ok FROM image",
    "s08_fixup": f"WITH {IMAGE_SQL} SELECT record_number % 10 AS digit, record_number % {TORN} <> {TORN - 1} AS fixup_ok, count(*) AS n, max(record_number) AS last FROM image GROUP BY 1, 2",
    "r06_timings": f"WITH {IMAGE_SQL} SELECT (SELECT count(*) FROM orders) AS total_records, count(*) AS used_records, (SELECT count(*) * 1024 FROM orders) AS bytes, count(*) FILTER (file_name = '.git') AS found, count(DISTINCT parent_record_number) FILTER (file_name = '.git') AS parents, true AS timed FROM image",
    "s22_skip_prefix": f"WITH {IMAGE_SQL} SELECT record_number, file_name FROM image WHERE record_number < (SELECT count(*) FROM supplier)",
    "u08_stream_with_cursor": _J + "SELECT batch, count(*) AS n_entries, max(usn) + 1 AS next_usn FROM (SELECT usn, (usn > (SELECT max(usn) // 2 FROM jrn))::BIGINT AS batch FROM jrn) GROUP BY batch",
    "u11_session_watch": _J + "SELECT CASE record_number % 2 WHEN 0 THEN 'C' ELSE 'D' END AS drive, usn, record_number, file_name FROM jrn WHERE usn > (SELECT max(usn) // 2 FROM jrn)",
    "u12_error_isolation": _J + "SELECT chr((67 + record_number % 6)::INTEGER) AS drive, count(*) AS n_entries, NULL::VARCHAR AS message FROM jrn WHERE record_number % 6 IN (0, 2) GROUP BY 1 UNION ALL VALUES ('D', 0, 'JournalWrapped'), ('F', 0, 'JournalNotActive'), ('G', 0, 'JournalError'), ('H', 0, 'JournalDeleting')",
    "s04_volume_scan": f"WITH {IMAGE_SQL} SELECT *, true AS fixup_ok FROM image WHERE record_number < (SELECT count(*) FROM customer)",
    "p08_skipping": f"WITH {VOL_SQL} SELECT record_number, parent_record_number, file_name, true AS skipped FROM vol WHERE lower(file_name) = 'order#1003'",
    "p09_skipping": f"WITH {VOL_SQL} SELECT record_number, parent_record_number, file_name, true AS skipped FROM vol WHERE contains(lower(file_name), 'mer#0000000')",
    "s12_point_reads": f"WITH {IMAGE_SQL} SELECT *, true AS fixup_ok FROM image WHERE record_number < (SELECT count(*) FROM customer) AND record_number IN (SELECT o_custkey * 7 % (2 * (SELECT count(*) FROM customer)) FROM orders)",
    "a09_live_inventory": f"WITH {VOL_SQL}, {JRN_SQL}, l AS (SELECT * FROM jrn QUALIFY row_number() OVER (PARTITION BY record_number ORDER BY usn DESC) = 1) SELECT coalesce(v.record_number, l.record_number) AS record_number, coalesce(l.file_name, v.file_name) AS file_name, coalesce(l.parent_record_number, v.parent_record_number) AS parent_record_number FROM vol v FULL JOIN l ON v.record_number = l.record_number WHERE coalesce((l.reason & 512) = 0, true)",
    "p05_attributes": ATTRIBUTES_SQL,
    "u13_late_subscriber": _J + "SELECT 'D' AS drive, usn, record_number FROM jrn WHERE record_number % 2 = 1",
    "u16_rescan": f"WITH {IMAGE_SQL}, {JRN_SQL} SELECT 'C' AS drive, (SELECT count(*) FROM image WHERE (flags & 2) <> 0 AND record_number <> 5) AS directories, (SELECT max(usn) // 2 + 1 FROM jrn) AS first_usn, (SELECT max(usn) + 1 FROM jrn) AS next_usn",
    "p22_utf16_names": "SELECT c_custkey::BIGINT AS c_custkey, c_name || ['', 'Ünïx', '😀'][(c_custkey % 3 + 1)::INTEGER] AS name, (length(c_name) + [0, 4, 2][(c_custkey % 3 + 1)::INTEGER])::BIGINT AS units FROM customer",
    "u17_warm_start": _J + "SELECT 'C' AS drive, usn, (SELECT max(usn) + 1 FROM jrn) AS next_usn FROM jrn WHERE usn >= (SELECT max(usn) // 2 FROM jrn)",
    "s09_data_runs": "SELECT o_orderkey::BIGINT AS o_orderkey, 1::BIGINT AS position, (o_custkey % 4000000)::BIGINT AS cluster, (o_orderkey % 200 + 1)::BIGINT AS clusters, false AS sparse FROM orders UNION ALL SELECT o_orderkey, 2, o_custkey % 4000000 - o_orderkey % 100 - 1, 7, false FROM orders",
    "p01_live_records": f"WITH {IMAGE_SQL} SELECT record_number, file_name FROM image",
    "h02_image_paths": _WALK + "SELECT s AS record_number, arg_max(path, d) AS full_path FROM walk GROUP BY s UNION ALL SELECT 5::BIGINT, NULL",
    "p17_image_scanner": _WALK + "SELECT s AS record_number, arg_max(path, d) AS full_path FROM walk WHERE s IN (SELECT record_number FROM image WHERE file_name = '.git') GROUP BY s",
    "s17_journal_decode": _J + "SELECT 'C' AS drive, 43981::BIGINT AS journal_id, usn, record_number, parent_record_number, epoch_us(ts) * 10 + 116444736000000000 AS filetime, reason, file_name FROM jrn",
    "s16_journal_since": _J + "SELECT usn, record_number, reason FROM jrn WHERE usn >= 500",
    "s15_journal_cursor": _J + "SELECT 43981::BIGINT AS journal_id, max(usn) + 1 AS next_usn FROM jrn",
    "u07_journal_stream": _J + "SELECT usn, record_number, reason FROM jrn WHERE usn >= 500",
    "k01_payload_roundtrip": f"WITH RECURSIVE {VOL_SQL}, {PATHS_SQL} SELECT v.record_number, v.parent_record_number, 0::BIGINT AS size, 0::BIGINT AS last_write_ticks, v.file_attributes AS attributes, (v.flags & 2) <> 0 AS is_directory, v.file_name AS name, 'C:' || chr(92) || p.path AS path FROM vol v JOIN paths p USING (record_number)",
    "u14_many_drives": _J + f""", own AS (
  SELECT 'D' || lpad((record_number % {DRIVES})::VARCHAR, 3, '0') AS drive, usn, (SELECT max(usn) // 4 FROM jrn) AS step FROM jrn
), firsts AS (SELECT drive, min(usn) AS first FROM own GROUP BY 1),
kept AS (SELECT drive, usn FROM own JOIN firsts USING (drive) WHERE CASE drive WHEN 'D007' THEN false WHEN 'D050' THEN usn < first + step WHEN 'D120' THEN usn < first + 2 * step ELSE true END)
SELECT d.drive, count(usn) AS n_entries, max(usn) + 1 AS next_usn,
  CASE WHEN any_value(first) IS NULL THEN 'JournalNotActive' WHEN d.drive = 'D050' THEN 'JournalDeleting' WHEN d.drive IN ('D007', 'D120') THEN 'JournalError' END AS message
FROM (SELECT 'D' || lpad(i::VARCHAR, 3, '0') AS drive FROM (SELECT unnest(range({DRIVES})) AS i)) d LEFT JOIN firsts USING (drive) LEFT JOIN kept USING (drive) GROUP BY d.drive""",
    "u07_bounded_batches": _J + "SELECT (usn - 1) // (SELECT max(usn) // 7 + 1 FROM jrn) AS batch, count(*) AS n_entries, min(usn) AS first_usn, max(usn) + 1 AS next_usn FROM jrn WHERE usn >= 1 GROUP BY 1",
    "k05_committed_batches": _J + "SELECT CASE record_number % 2 WHEN 0 THEN 'C' ELSE 'D' END AS drive, usn, record_number, file_name, max(usn) OVER (PARTITION BY record_number % 2) + 1 AS cursor FROM jrn",
    "s17_split_segment": _J + "SELECT 'C' AS drive, 43981::BIGINT AS journal_id, usn, record_number, parent_record_number, epoch_us(ts) * 10 + 116444736000000000 AS filetime, reason, file_name FROM jrn",
    "c02_frames": _J + "SELECT record_number, parent_record_number, usn, epoch_us(ts) * 10 + 116444736000000000 AS filetime, reason, 32::BIGINT AS attributes, file_name FROM jrn",
}
