"""Journals in ranges, streams over many drives, and the log of their batches."""

import random
import struct
from decimal import Decimal

import pytest

from inodeon.model import SessionState
from inodeon.sources import usn_journal
from inodeon.streaming.batchlog import COMPACT, BatchLog
from inodeon.streaming.session import Drive, WatchSession


def tricky_names(rng, n):
    """Names some of which look like records: their units spell lengths, versions and name places."""
    out = []
    for _ in range(n):
        fake = struct.pack("<IHH", 8 * rng.randint(8, 40), 2, 0) + b"\x41\0" * rng.randint(0, 60)
        name = fake.decode("utf-16-le", "replace").replace("\ud800", "x") if rng.random() < 0.5 else "f" * rng.randint(1, 200)
        out.append("".join(c for c in name if not 0xD800 <= ord(c) < 0xE000) or "x")
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ranges_read_each_record_once(seed, monkeypatch, tmp_path):
    rng = random.Random(seed)
    names = tricky_names(rng, 700)
    usns = sorted(rng.sample(range(64, 60_000), 700))
    usn_journal.append_segment(str(tmp_path), 7, usns[0], usns[-1] + 1, [(8 * i, 5, u, 1, 2, 0, n) for i, (u, n) in enumerate(zip(usns, names))])
    for look_back, size in ((512, 700), (512, 5000), (16 << 10, 4096), (600, 64), (1 << 17, 30_000), (512, 1 << 20)):
        monkeypatch.setattr(usn_journal, "LOOK_BACK", look_back)
        monkeypatch.setattr(usn_journal, "MAX_RECORD", 512)
        reader = usn_journal.UsnReader({"path": str(tmp_path), "rangeBytes": str(size)})
        parts = reader.partitions()
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [r["usn"] for r in got] == usns and [r["file_name"] for r in got] == names
        assert size > 5000 or len(parts) > 20


def test_many_ranges_are_read_by_few_tasks(tmp_path):
    names = tricky_names(random.Random(1), 3000)
    for first in (0, 1000, 2000):
        usn_journal.append_segment(str(tmp_path), 7, first, first + 1000, [(8 * i, 5, i, 1, 2, 0, names[i]) for i in range(first, first + 1000)])
    for size, many in ((64, True), (256, True), (100_000, False)):
        reader = usn_journal.UsnReader({"path": str(tmp_path), "rangeBytes": str(size)})
        ranges, parts = reader.slices("", str(tmp_path), 0, 0, 1 << 62), reader.partitions()
        assert usn_journal.TASKS // 2 < len(parts) < 2 * usn_journal.TASKS < len(ranges) if many else len(parts) == len(ranges)
        spans = [(s.path, s.lo, s.hi) for p in parts for s in p.parts]
        assert sum(hi - lo for _, lo, hi in spans) == sum(r.hi - r.lo for r in ranges) and {(r.path, r.lo) for r in ranges if r.lo == 8} <= {x[:2] for x in spans}
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [r["usn"] for r in got] == list(range(3000)) and [r["file_name"] for r in got] == names


def test_range_without_a_record_and_cut_tail(tmp_path):
    usn_journal.append_segment(str(tmp_path), 7, 0, 3, [(1, 5, i, 1, 2, 0, "n" * 250) for i in range(3)])
    (path,) = tmp_path.glob("*.usn")
    raw = path.read_bytes()
    for cut in (len(raw), len(raw) - 9, 700, 9, 8):
        path.write_bytes(raw[:cut])
        whole = len(usn_journal.decode_buffer(raw[:cut])[1])
        for size in (64, 128, 1000):
            reader = usn_journal.UsnReader({"path": str(tmp_path), "rangeBytes": str(size)})
            assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == whole


def entries(numbers):
    return [(6, 5, i, 1, 2, 0, "x") for i in numbers]


def test_one_drive_fails_and_the_others_go_on(spark, tmp_path):
    for k in "CDE":
        usn_journal.append_segment(str(tmp_path / k), 7, 0, 10, entries(range(10)))
    s = WatchSession(spark, str(tmp_path / "watch"))
    told = []
    s.on_drive_fault(lambda k, e: told.append(k))
    s.warm_start([Drive(k, "", str(tmp_path / k)) for k in "CDE"], {"C": (7, 4), "D": (8, 4), "E": (7, 9)})
    s.watch(trigger={"availableNow": True})
    s.await_end()
    assert sorted(r.usn for r in s.delivered("C").collect()) == list(range(4, 10)) and told == ["D"]
    with pytest.raises(Exception, match="created anew"):
        s.delivered("D")
    assert s.kept("D") is None and s.kept().count() == 7 and s.state is SessionState.WATCHING
    assert s.stop() == {"C": (7, 10), "D": (8, 4), "E": (7, 10)} and s.state is SessionState.PARKED
    usn_journal.append_segment(str(tmp_path / "C"), 7, 10, 12, entries(range(10, 12)))

    def deliver(drive, batch, cursor):  # a consumer's fault is its drive's too
        raise RuntimeError("full")

    s.watch(deliver, {"availableNow": True})
    s.await_end()
    assert set(s.faults) == {"C", "D"} and s.cursors["C"] == (7, 10)
    late = []
    s.on_drive_fault(lambda k, e: late.append(k))
    assert late == ["D", "C"] and s.stop()["E"] == (7, 10)
    s.dispose()


def test_no_drive_left_is_the_session_s_fault(spark, tmp_path):
    s = WatchSession(spark, str(tmp_path / "watch"))
    s.warm_start([Drive("C", "", str(tmp_path / "none"))], {"C": (7, 4)})
    s.watch(trigger={"availableNow": True})
    with pytest.raises(Exception, match="no journal"):
        s.await_end()
    assert s.state is SessionState.FAULTED and s.stop() == {"C": (7, 4)}
    s.dispose()


def test_bounded_batches_skip_long_gaps(spark, tmp_path):
    for first in (0, 10, 10**9):
        usn_journal.append_segment(str(tmp_path / "C"), 7, first, first + 10, entries(range(first, first + 10)))
    s = WatchSession(spark, str(tmp_path / "watch"))
    s.warm_start([Drive("C", "", str(tmp_path / "C"))], {"C": (7, 3)})
    s.watch(trigger={"availableNow": True}, max_usn=6)
    s.await_end()
    assert [b.entries.get("C") for b in s.batches()] == [6, 6, 5, 6, 4] and s.stop() == {"C": (7, 10**9 + 10)}
    s.dispose()
    with pytest.raises(ValueError, match="position"):
        usn_journal.UsnStreamReader({"path": str(tmp_path / "C"), "maxUsnPerBatch": "3"})


def test_log_keeps_each_batch_once_and_compacts(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path))
    schema = "drive string, journal_id decimal(20,0), usn long, error string"
    frame = lambda *rows: spark.createDataFrame([(k, j and Decimal(j), u, e) for k, j, u, e in rows], schema)
    assert log.batches() == [] and log.rows() is None and log.cursors() == {}
    log.commit(COMPACT - 2, frame(("C", 7, 1, None), ("D", None, None, "gone")))
    log.commit(COMPACT - 2, frame(("C", 7, 99, None)))  # the same batch again
    log.commit(COMPACT - 1, frame(("C", 7, 2, None), ("D", 7, 5, None)))
    log.commit(COMPACT, frame())
    again = BatchLog(spark, str(tmp_path))
    assert [b.number for b in again.batches()] == [COMPACT - 2, COMPACT - 1, COMPACT]
    assert sorted((r.drive, r.usn) for r in again.rows().collect()) == [("C", 1), ("C", 2), ("D", 5)]
    assert again.cursors() == {"C": (7, 3), "D": (7, 6)} and again.errors() == {"D": "gone"}
    assert [r.usn for r in again.rows(drive="D").collect()] == [5]


def test_point_reads_read_little_and_miss_nothing(spark, tmp_path):
    from inodeon.sources import mft, synthetic

    path = str(tmp_path / "disk.img")
    mft.write_volume(path, 5000)
    rows = synthetic.rows(0, 5000)
    live = set((~rows["zeroed"] & (rows["base_reference"] == 0)).nonzero()[0].tolist())
    wanted = [0, 5, 77, 78, 79, 1200, 1249, 1250, 1251, 2499, 2500, 2501, 3000, 4998, 4999, 5000, 10**9, -3, 77]
    frame = spark.createDataFrame([(n,) for n in wanted], "record_number long")
    got = mft.point_reads(spark, frame, path, layout="volume").collect()
    assert {r.record_number for r in got} == live & set(wanted) and len(got) == len(live & set(wanted))
    assert all(r.file_name == rows["file_name"][r.record_number] for r in got if r.record_number > 5)
    assert sum(r.bytes_read for r in got) < 60 * 1024
    many = mft.point_reads(spark, spark.range(0, 5000, 2).withColumnRenamed("id", "record_number"), path, layout="volume").collect()
    assert {r.record_number for r in many} == {n for n in live if n % 2 == 0} and sum(r.bytes_read for r in many) <= 5000 * 1024


def test_live_inventory_takes_late_and_repeated_entries_once(spark, tmp_path):
    from inodeon.streaming.inventory import LiveInventory

    entry = lambda record, usn, name, reason=2: (record, 5, usn, 1, reason, 0, name)
    first = [entry(1, 10, "a"), entry(2, 11, "b"), entry(1, 12, "a2"), entry(3, 13, "c", 0x200), entry(9, 14, "new", 0x100)]
    usn_journal.append_segment(str(tmp_path / "j"), 7, 10, 15, first)
    scan = spark.createDataFrame([("C", i, 5, f"old{i}") for i in range(1, 5)], "drive string, record_number long, parent_record_number long, file_name string")
    live = LiveInventory(spark, str(tmp_path / "live"))
    assert live.changes() is None and live.records(scan).count() == 4
    for segment in ([], [entry(1, 8, "older"), entry(3, 20, "c", 0x100)], [entry(3, 13, "c", 0x200), entry(4, 21, "d", 0x80000200)]):
        if segment:
            usn_journal.append_segment(str(tmp_path / "j"), 7, max(15, segment[-1][2]), segment[-1][2] + 1, segment)
        live.follow(usn_journal.stream_journal(spark, str(tmp_path / "j"), 1 if segment else 0, 7 if segment else 0, "C"), {"availableNow": True}).awaitTermination()
    again = LiveInventory(spark, str(tmp_path / "live"))
    assert {(r.record_number, r.file_name) for r in again.records(scan).collect()} == {(1, "a2"), (2, "b"), (3, "c"), (9, "new")}


def test_live_inventory_has_few_parts_of_state(spark, tmp_path):
    from inodeon.streaming.inventory import PARTS_PER_CORE, LiveInventory

    usn_journal.append_segment(str(tmp_path / "j"), 7, 0, 50, [(i, 5, i, 1, 2, 0, f"n{i}") for i in range(50)])
    live, before = LiveInventory(spark, str(tmp_path / "live")), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for _ in range(2):
            live.follow(usn_journal.stream_journal(spark, str(tmp_path / "j"), 0, 7, "C"), {"availableNow": True}).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.read.format("state-metadata").load(live.checkpoint).first().numPartitions == PARTS_PER_CORE * spark.sparkContext.defaultParallelism < 40
    assert sorted(r.record_number for r in live.changes().collect()) == list(range(50))


def test_many_segments_take_few_tasks():
    slices = [usn_journal.SegmentSlice("C", f"s{k}", 7, 0, 1 << 62, 8, 200_000) for k in range(1500)]
    groups = usn_journal.dealt(slices)
    assert len(groups) <= 40 and [p for g in groups for p in g.parts] == slices


def test_segments_of_many_drives_are_no_smaller(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from inodeon.queries import binary

    monkeypatch.setattr(binary, "SEGMENT", 10)
    key = F.concat(F.lit("D"), (F.col("record_number") % 20).cast("string"))
    folder = binary._written_journals(spark, "/root/testdata/sf0.001", key, folder=str(tmp_path), drives=20)
    found = {k.name: len(list(k.glob("*.usn"))) for k in tmp_path.iterdir()}
    n = binary.journal(spark, "/root/testdata/sf0.001").count()
    assert 1 <= max(found.values()) <= -(-n // 200) and len(found) <= 20
    assert sum(usn_journal.read_journal(spark, f"{folder}/{k}").count() for k in found) == n
