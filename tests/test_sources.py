import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inodeon.model import JournalError, JournalNotActive, JournalWrapped, MatchFlags, SessionState
from inodeon.operators import match, paths
from inodeon.sources import frames, mft, ntfs, scan_payload, synthetic, usn_journal
from inodeon.streaming.session import Drive, WatchSession, drive_key

# Counts that the generator's rules give.
COUNTS = {20: (15, 1, 4, 3, 1, 0, 2), 100: (76, 9, 15, 16, 2, 5, 4), 1000: (750, 95, 155, 167, 10, 43, 18), 5000: (3773, 487, 740, 742, 38, 236, 136), 100_000: (74_834, 10_203, 14_963, 14_968, 951, 4_737, 3_721)}


@pytest.mark.parametrize("n", COUNTS)
def test_generator_counts(n):
    r = synthetic.rows(0, n)
    live = ~r["zeroed"] & (r["base_reference"] == 0)
    names = r["file_name"][live]
    got = (live.sum(), r["zeroed"].sum(), (r["base_reference"] > 0).sum(), (live & (r["flags"] & 2 > 0)).sum(), (names == ".git").sum(), sum("config" in x for x in names), (names == "README.md").sum())
    assert got == COUNTS[n]


def test_rows_don_t_depend_on_the_slice():
    whole, part = synthetic.rows(0, 500), synthetic.rows(123, 321)
    for k in whole:
        assert (whole[k][123:321] == part[k]).all()


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("image") / "t.mft")
    mft.write_synthetic(path, 1000)
    return path


def test_image_round_trip(spark, image):
    got = {r.record_number: r for r in mft.read_image(spark, image, recordsPerPartition=170, drive="C").collect()}
    r = synthetic.rows(0, 1000)
    live = np.flatnonzero(~r["zeroed"] & (r["base_reference"] == 0))
    assert sorted(got) == live.tolist() and mft.total_records(image) == 1000
    for i in live:
        x = got[i]
        assert (x.parent_record_number, x.flags, x.file_attributes, x.file_name) == (r["parent_record_number"][i], r["flags"][i], r["file_attributes"][i], r["file_name"][i])
        assert x.fixup_ok and x.drive == "C" and x.in_use and x.is_directory == bool(x.flags & 2)


def test_filters_reach_the_source(spark, image):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: mft.read_image(spark, image, pushFilters=True)
        assert match.find_by_name(load(), "CONFIG", MatchFlags.CONTAINS).count() == 43
        assert match.find_by_name(load(), "readme.MD").count() == 18
        found = load().where("is_directory and record_number >= 500 and record_number < 900")
        assert found.count() == mft.read_image(spark, image).where((F.col("flags").bitwiseAND(2) != 0) & F.col("record_number").between(500, 899)).count()
        plan = match.find_by_name(load(), "readme.MD")._jdf.queryExecution().executedPlan().toString()
        assert "Filter (name_fold" not in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    spark.dataSource.register(mft.MftSource)
    assert spark.read.format("mft").option("path", image).load().where("name_fold = 'readme.md'").count() == 18


def test_corrupt_records(spark, image, tmp_path):
    raw = bytearray(open(image, "rb").read()[: 20 * 1024])
    torn, unused, strange = (bytearray(raw) for _ in range(3))
    live = [i for i in range(20) if raw[i * 1024 : i * 1024 + 4] == b"FILE" and not any(raw[i * 1024 + 0x20 : i * 1024 + 0x26])]
    at = live[-1] * 1024
    torn[at + 510] ^= 0xFF
    unused[at + 0x16 : at + 0x18] = b"\0\0"
    strange[at + 6 : at + 8] = b"\x04\x00"
    for name, data, rows, bad in (("torn", torn, 15, 1), ("unused", unused, 14, 0), ("strange", strange, 15, 0)):
        p = tmp_path / name
        p.write_bytes(bytes(data) + b"tail")
        got = mft.read_image(spark, str(p))
        assert got.count() == rows and got.where("not fixup_ok").count() == bad
    with pytest.raises(Exception, match="FileNotFoundError"):
        mft.read_image(spark, str(tmp_path / "none")).count()


def volume(extensions=(), listed=None):
    """A 2 MiB volume of 4 KiB clusters with its table in two runs, the second one in an extension record."""
    raw = bytearray(2 << 20)
    raw[3:7] = b"NTFS"
    struct.pack_into("<HB", raw, 0x0B, 512, 8)
    struct.pack_into("<Q", raw, 0x30, 1)

    def record(number, attributes, base=0):
        out = bytearray(1024)
        out[:4] = b"FILE"
        struct.pack_into("<HH", out, 4, 0x30, 3)
        struct.pack_into("<HH", out, 0x14, 0x38, 1)
        struct.pack_into("<Q", out, 0x20, base)
        p = 0x38
        for a in attributes:
            out[p : p + len(a)] = a
            p += len(a)
        struct.pack_into("<I", out, p, 0xFFFFFFFF)
        mark = b"\x07\x00"
        out[0x30:0x32] = mark
        for s in (0, 1):
            out[0x32 + 2 * s : 0x34 + 2 * s] = out[512 * s + 510 : 512 * s + 512]
            out[512 * s + 510 : 512 * s + 512] = mark
        return bytes(out)

    def data(cluster, count):
        a = bytearray(72)
        struct.pack_into("<IIB", a, 0, 0x80, 72, 1)
        struct.pack_into("<H", a, 0x20, 64)
        a[64:69] = bytes([0x12, count & 255, count >> 8, cluster, 0])
        return bytes(a)

    def attribute_list(segments):
        content = b"".join(struct.pack("<IHBBQQH", 0x80, 28, 0, 0, 0, s, 0).ljust(28, b"\0") for s in segments)
        a = struct.pack("<IIBBHHHIHH", 0x20, (24 + len(content) + 7) // 8 * 8, 0, 0, 0, 0, 0, len(content), 24, 0) + content
        return a.ljust((len(a) + 7) // 8 * 8, b"\0")

    attributes = ([attribute_list(listed)] if listed is not None else []) + [data(1, 1)]
    raw[4096:5120] = record(0, attributes)
    for number, body in extensions:
        raw[4096 + number * 1024 : 5120 + number * 1024] = body if isinstance(body, bytes) else record(number, [data(*body)], base=0)
    return bytes(raw)


def test_volume_extents(tmp_path):
    p = tmp_path / "v"
    p.write_bytes(volume())
    assert mft.volume_extents(str(p)) == [(4096, 4096)]
    p.write_bytes(volume([(1, (10, 2)), (2, (20, 3))], [1, 2, 1, 0]))
    assert mft.volume_extents(str(p)) == [(4096, 4096), (40960, 8192), (81920, 12288)]
    p.write_bytes(volume([(1, b"junk".ljust(1024, b"\0"))], [1, 9999]))
    assert mft.volume_extents(str(p)) == [(4096, 4096)]
    p.write_bytes(b"\0" * 4096)
    with pytest.raises(ValueError, match="not an NTFS volume"):
        mft.volume_extents(str(p))


def test_volume_layout_reads_runs_in_order(spark, tmp_path):
    raw = bytearray(volume([(1, (10, 2))], [1]))
    raw[40960 : 40960 + 8192] = synthetic.image(4, 12)
    p = tmp_path / "v"
    p.write_bytes(bytes(raw))
    names = {r.record_number: r.file_name for r in mft.read_image(spark, str(p), layout="volume").collect()}
    r = synthetic.rows(4, 12)
    assert names == {4 + i: r["file_name"][i] for i in range(8) if not r["zeroed"][i] and not r["base_reference"][i]}


def test_data_runs():
    a = bytearray(80)
    struct.pack_into("<IIB", a, 0, 0x80, 80, 1)
    struct.pack_into("<H", a, 0x20, 64)
    a[64:76] = bytes([0x11, 3, 10, 0x11, 4, 0xFE, 0x01, 5, 0x11, 1, 1, 0])
    assert ntfs.data_runs(bytes(a), 0) == [(10, 3, False), (8, 4, False), (8, 5, True), (9, 1, False)]
    a[8] = 0
    assert ntfs.data_runs(bytes(a), 0) == []


ENTRIES = [(100, 5, 1000, 132223104000000000, 0x100, 0x20, "newfile.txt"), (200 | 7 << 48, 5, 1500, 0, 0x200, 0, "nöte.txt")]


def test_journal_buffers():
    raw = usn_journal.encode_buffer(2000, ENTRIES)
    nxt, got = usn_journal.decode_buffer(raw)
    assert nxt == 2000 and got == [ENTRIES[0], (200, *ENTRIES[1][1:])]
    assert usn_journal.decode_buffer(raw[:4]) == (None, [])
    assert usn_journal.decode_buffer(struct.pack("<q", 2000) + b"\0" * 64) == (2000, [])
    assert len(usn_journal.decode_buffer(usn_journal.encode_buffer(1, [(i, 5, i, 1, 1, 1, "n" * (i % 30)) for i in range(1400)]))[1]) == 1400
    assert len(usn_journal.decode_buffer(raw[:-4])[1]) == 1


def test_journal_reads_and_errors(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(JournalNotActive):
        usn_journal.query_cursor(folder)
    usn_journal.append_segment(folder, 7, 1000, 1400, [(1, 5, 1000 + i, 1, 1, 1, "a") for i in range(400)])
    usn_journal.append_segment(folder, 7, 1400, 1500, [(2, 5, 1400 + i, 1, 1, 1, "b") for i in range(100)])
    assert usn_journal.query_cursor(folder) == (7, 1500)
    assert usn_journal.read_journal(spark, folder).count() == 500
    assert usn_journal.read_journal(spark, folder, 1399, 7).count() == 101
    with pytest.raises(Exception, match="full rescan"):
        usn_journal.read_journal(spark, folder, 999, 7).count()
    with pytest.raises(Exception, match="created anew"):
        usn_journal.read_journal(spark, folder, 1200, 6).count()
    assert issubclass(JournalWrapped, JournalError)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, seen = str(tmp_path / "j"), []
    add = lambda first, n: usn_journal.append_segment(folder, 7, first, first + n, [(1, 5, first + i, 1, 1, 1, "a") for i in range(n)])

    def run():
        q = usn_journal.stream_journal(spark, folder, 3).writeStream.foreachBatch(lambda df, _: seen.append(sorted(r.usn for r in df.collect())))
        q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    add(0, 5)
    with pytest.raises(Exception, match="."):
        usn_journal.read_journal(spark, folder, 1, 99).count()
    run()
    add(5, 4)
    run()
    run()
    assert [x for b in seen for x in b] == [3, 4, 5, 6, 7, 8]
    usn_journal.append_segment(folder, 8, 0, 3, [(1, 5, i, 1, 1, 1, "a") for i in range(3)])
    with pytest.raises(Exception, match="created anew"):
        run()


SCAN = [(5, 5, 0, 0, 0x10, True, "C:", "C:\\"), (100, 5, 2048, 638000000000000000, 0x20, False, "nöte.txt", "C:\\nöte.txt"), (7, 5, 2**64 - 1, 1, 0x20, False, "\U0001f600", "")]


def payload(rows):
    columns = list(zip(*rows))
    columns[2] = [Decimal(v) for v in columns[2]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, scan_payload._SCHEMA)], schema=scan_payload._SCHEMA)


def test_payload(spark, tmp_path, monkeypatch):
    assert len(scan_payload.encode([payload([(1, 0, 512, 100, 0x20, False, "ab", "X:\\ab")])])) == 98 and len(scan_payload.encode([])) == 28
    place = tmp_path / "one.scan"
    place.write_bytes(scan_payload.encode([payload(SCAN[:1]), payload(SCAN[1:])]))
    rows = lambda first, count: [tuple(int(v) if k == 2 else v for k, v in enumerate(r.values())) for r in scan_payload.decode(str(place), first, count).to_pylist()]
    assert scan_payload.row_count(str(place)) == len(SCAN) and rows(0, len(SCAN)) == SCAN
    assert rows(1, 2) == SCAN[1:3] and rows(0, 0) == []
    monkeypatch.setattr(scan_payload, "SLICE_ROWS", 2)
    assert len(scan_payload.PayloadReader(str(tmp_path)).partitions()) == -(-len(SCAN) // 2)
    place.write_bytes(b"\0" * 40)
    with pytest.raises(ValueError, match="not a scan payload"):
        scan_payload.row_count(str(place))


def test_frames():
    assert frames.write("Shutdown").hex() == "0100000003" and frames.write("Heartbeat").hex() == "0100000008"
    assert frames.write("EndWatch").hex() == "0100000009" and frames.write("EndWatchAck").hex() == "010000000a"
    assert frames.write("StartWatch", drives_spec="C").hex() == "0700000002" + "02000000" + "4300"
    assert frames.write("ArmAndScan", drives_spec="C").hex() == "0b00000001" + "02000000" + "4300" + "00000000"
    made = {
        "ArmAndScan": {"drives_spec": "C:1:2,D:3:4", "keep_names": ["a", "ö"]},
        "ScanReady": {"map_name": "m", "record_count": 3, "byte_length": 9},
        "Cursor": {"drive": "C", "journal_id": 2**64 - 1, "next_usn": -1},
        "JournalBatch": {"drive": "C", "journal_id": 1, "next_usn": 2, "entries": [(1, 2, 3, 4, 0x80000000, 6, "name")]},
        "Error": {"drive": "D", "message": "gone"},
    }
    for kind, values in made.items():
        raw = frames.write(kind, **values)
        assert frames.read(raw + b"more") == (kind, values, len(raw))
    with pytest.raises(frames.InvalidFrame):
        frames.read(b"\x01\0\0\0\x63")
    with pytest.raises(frames.InvalidFrame):
        frames.write("Cursor", drive="C")


def test_session(spark, image, tmp_path):
    journal = str(tmp_path / "journal")
    usn_journal.append_segment(journal, 7, 0, 10, [(6, 5, i, 1, 2, 0, ".git") for i in range(10)])
    s = WatchSession(spark, str(tmp_path / "watch"))
    with pytest.raises(RuntimeError, match="No drives to watch"):
        s.watch(lambda *a: None)
    result = s.start([Drive("c:\\", image, journal), Drive("D", str(tmp_path / "none"), journal), Drive("E", image, str(tmp_path / "no-journal"))])
    assert set(result.scans) == {"C"} and set(result.errors) == {"D", "E"} and result.advanced == {"C": (7, 10)}
    assert result.armed["D"] == (7, 10) and result.records.where("path = 'C:\\\\tests\\\\.git'").count() == 1
    assert result.records.where("record_number = 5").count() == 0 and result.cursors(spark).count() == 1
    usn_journal.append_segment(journal, 7, 10, 15, [(6, 5, i, 1, 2, 0, ".git") for i in range(10, 15)])
    got = []
    s.watch(lambda d, df, c: got.append((d, sorted(r.usn for r in df.collect()), c)), {"availableNow": True})
    with pytest.raises(RuntimeError):
        s.watch(lambda *a: None)
    with pytest.raises(ValueError, match="not watched"):
        s.query("X")
    s.await_end()
    assert got == [("C", [10, 11, 12, 13, 14], (7, 15))]
    assert s.stop() == {"C": (7, 15)} and s.state is SessionState.PARKED
    again = WatchSession(spark, str(tmp_path / "again"))
    again.warm_start([Drive("C", image, journal)], {"c:": (7, 12)})
    again.watch(lambda d, df, c: got.append((d, df.count(), c)), {"availableNow": True})
    again.await_end()
    assert got[-1] == ("C", 3, (7, 15))
    again.stop()
    usn_journal.append_segment(journal, 9, 0, 1, [(6, 5, 0, 1, 2, 0, "x")])
    faults = []
    again.watch(lambda *a: None, {"availableNow": True})
    again.on_fault(faults.append)
    with pytest.raises(Exception, match="created anew"):
        again.await_end()
    again.on_fault(faults.append)
    assert len(faults) == 2 and again.state is SessionState.FAULTED
    s.dispose()
    assert s.state is SessionState.DISPOSED and drive_key("d:\\") == "D"


def test_paths_of_the_image(spark, image):
    rows = mft.read_image(spark, image)
    got = {r.record_number: r.full_path for r in paths.resolve_paths(rows, rows, plan="doubling").collect()}
    assert got[0] == "$MFT" and got[1] == got[4] == "$MFT\\$MFT" and got[5] is None
    assert got[545] == "cache\\setup.py\\tests\\build.gradle" and got[685] == "test.go\\icon.png\\style.css\\obj"


@pytest.mark.parametrize("names", [[], [""], ["Abc", "", "README.md"], ["nöte.txt", "", "\U0001f600x", "plain"]])
def test_strings_of_units(names):
    units = np.frombuffer("".join(names).encode("utf-16-le"), dtype="<u2").astype(np.uint16)
    lengths = np.array([len(n.encode("utf-16-le")) // 2 for n in names], dtype=np.int64)
    assert ntfs.strings(units, lengths).to_pylist() == names


def test_image_writer_makes_parts(spark, tmp_path):
    spark.dataSource.register(mft.MftSource)
    parts = spark.createDataFrame([(0, 600), (600, 400)], "first long, count long")
    parts.write.format("mft").option("path", str(tmp_path)).mode("append").save()
    raw = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("part-*.mft")))
    assert raw == synthetic.image(0, 600) + synthetic.image(600, 1000)


def test_folder_of_parts_with_torn_sectors(spark, tmp_path):
    folder = str(tmp_path / "image")
    mft.write_image(spark, folder, 1000, 300, tornEvery=7)
    got = {r.record_number: r for r in mft.read_image(spark, folder, recordsPerPartition=170).collect()}
    r = synthetic.rows(0, 1000)
    live = np.flatnonzero(~r["zeroed"] & (r["base_reference"] == 0))
    assert sorted(got) == live.tolist()
    assert all(got[i].fixup_ok == (i % 7 != 6) for i in live) and got[int(live[-1])].file_name == r["file_name"][live[-1]]
    rows, seen = mft.measured_image(spark, folder, recordsPerPartition=250)
    assert rows.where("file_name = '.git'").count() == rows.where("file_name = '.git'").count() > 0
    timed = seen.get
    assert timed["total_records"] == 1000 and timed["used_records"] == len(live) and timed["bytes"] == 1000 * 1024 and timed["parse_ms"] > 0 < timed["fixup_ms"]


def test_measured_chunks_without_records(spark, tmp_path):
    (tmp_path / "zero.mft").write_bytes(b"\0" * 10240)
    rows, seen = mft.measured_image(spark, str(tmp_path / "zero.mft"))
    assert rows.count() == 0 and seen.get["total_records"] == 10 and seen.get["used_records"] == 0


def test_payload_files_end_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan_payload, "FILE_BYTES", 4000)
    monkeypatch.setattr(scan_payload, "BATCH_ROWS", 16)
    some = [(i, 5, i, 0, 0x20, False, None if i % 9 == 0 else "n\u00f6\U0001f600" * (i % 5), f"C:\\{i}") for i in range(300)]
    done = scan_payload.PayloadWriter(str(tmp_path)).write(iter([payload(some[:200]), payload(some[200:])]))
    assert len(done.paths) > 5
    got = [r for p in done.paths for r in scan_payload.decode(p, 0, scan_payload.row_count(p)).to_pylist()]
    assert [(r["record_number"], r["name"], r["path"]) for r in got] == [(i, name or "", path) for i, _, _, _, _, _, name, path in some]


def test_prefix_is_found(spark, image, tmp_path):
    raw = open(image, "rb").read()
    (tmp_path / "p.mft").write_bytes(b"x" * 20 + raw)
    for path in (image, str(tmp_path / "p.mft")):
        assert mft.read_image(spark, path, skipPrefix="auto").count() == 750


def test_second_session_in_the_same_folder_keeps_to_its_cursors(spark, image, tmp_path):
    journal = str(tmp_path / "journal")
    usn_journal.append_segment(journal, 7, 0, 10, [(6, 5, i, 1, 2, 0, "x") for i in range(10)])
    got = []
    for start in (2, 6):
        s = WatchSession(spark, str(tmp_path / "watch"))
        s.warm_start([Drive("C", image, journal)], {"C": (7, start)})
        s.watch(lambda d, df, c: got.append((df.count(), c)), {"availableNow": True})
        s.await_end()
        s.dispose()
    assert got == [(8, (7, 10)), (4, (7, 10))]


def test_all_streams_start_or_none(spark, image, tmp_path):
    journal = str(tmp_path / "journal")
    usn_journal.append_segment(journal, 7, 0, 10, [(6, 5, i, 1, 2, 0, "x") for i in range(10)])
    s = WatchSession(spark, str(tmp_path / "watch"))
    s.warm_start([Drive("C", image, journal)], {"C": (7, 2), "Z": (7, 2)})  # Z is no drive of the session
    with pytest.raises(KeyError):
        s.watch(lambda *a: None)
    assert s.state is SessionState.PARKED and not [q for q in spark.streams.active if str(q.id) in s.query_ids]
    with pytest.raises(RuntimeError, match="no journal"):
        s.rescan([Drive("Y", image, str(tmp_path / "nowhere"))])
    assert set(s._drives) == {"C"} and s.cursors["C"] == (7, 2)
    s.dispose()


def test_faults_are_latched_without_waiting(spark, image, tmp_path):
    import time

    journal = str(tmp_path / "journal")
    usn_journal.append_segment(journal, 7, 0, 10, [(6, 5, i, 1, 2, 0, "x") for i in range(10)])
    s = WatchSession(spark, str(tmp_path / "watch"))
    s.warm_start([Drive("C", image, journal)], {"C": (8, 2)})  # of a journal that was created anew
    faults = []
    s.on_fault(faults.append)
    s.watch(lambda *a: None)
    for _ in range(100):
        if faults:
            break
        time.sleep(0.2)
    assert len(faults) == 1 and s.state is SessionState.FAULTED and "created anew" in str(faults[0])
    s.dispose()


def test_journal_that_is_being_deleted(spark, tmp_path):
    journal = str(tmp_path / "journal")
    usn_journal.append_segment(journal, 7, 0, 10, [(6, 5, i, 1, 2, 0, "x") for i in range(10)])
    (tmp_path / "journal" / "7.deleting").write_text("")
    found, errors = usn_journal.read_drives(spark, {"C": (journal, 7, 0)})
    assert found is None and errors["C"].startswith("JournalDeleting")


def test_closed_volume(spark, image, tmp_path):
    with mft.Volume(spark, image, drive="C") as v:
        assert v.records().count() == 750
    with pytest.raises(RuntimeError, match="closed"):
        v.records()
    with pytest.raises(FileNotFoundError):
        mft.Volume(spark, str(tmp_path / "none"))


def test_late_subscriber_gets_what_was_kept(spark, image, tmp_path):
    journal = str(tmp_path / "journal")
    usn_journal.append_segment(journal, 7, 0, 10, [(6, 5, i, 1, 2, 0, "x") for i in range(10)])
    s = WatchSession(spark, str(tmp_path / "watch"))
    s.warm_start([Drive("C", image, journal), Drive("D", image, journal)], {"C": (7, 4), "D": (7, 9)})
    assert s.delivered("C") is None
    s.watch(trigger={"availableNow": True})
    s.await_end()
    s.stop()
    usn_journal.append_segment(journal, 7, 10, 12, [(6, 5, i, 1, 2, 0, "x") for i in range(10, 12)])
    s.watch(trigger={"availableNow": True})
    s.await_end()
    assert sorted(r.usn for r in s.delivered("c:").collect()) == list(range(4, 12)) and sorted(r.usn for r in s.delivered("D").collect()) == [9, 10, 11]
    s.latch(RuntimeError("gone"))
    with pytest.raises(RuntimeError, match="gone"):
        s.delivered("C")
    s.dispose()


def test_command_line(spark, image, tmp_path):
    from inodeon import __main__ as cli

    cli.main([image, ".git", "--exact", "--paths", "--drive", "C", "--out", str(tmp_path / "out")])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == COUNTS[1000][4] and got.where("full_path like 'C:%.git'").count() == got.count()
    assert cli.result(spark, cli.arguments([image, "config"])).count() == COUNTS[1000][5]
    assert cli.result(spark, cli.arguments([image])).count() == 25
    assert "1000 records in" in cli.result(spark, cli.arguments([image, "--report"])).first().line
    with pytest.raises(SystemExit):
        cli.arguments([])


def test_prefixed_parts_of_more_than_a_chunk(spark, tmp_path):
    mft.write_image(spark, str(tmp_path / "image"), 9000, prefix=True)
    got = {r.record_number: r.file_name for r in mft.read_image(spark, str(tmp_path / "image"), skipPrefix="auto").select("record_number", "file_name").collect()}
    r = synthetic.rows(0, 9000)
    live = np.flatnonzero(~r["zeroed"] & (r["base_reference"] == 0)).tolist()
    assert sorted(got) == live and all(got[i] == r["file_name"][i] for i in live)


def test_many_slices_and_files_take_few_tasks(spark, tmp_path):
    path = str(tmp_path / "image")
    mft.write_image(spark, path, 2000, per_file=5)
    assert len(list((tmp_path / "image").glob("*.mft"))) == 400
    reader = mft.MftReader({"path": path, "recordsPerPartition": "3"})
    parts = reader.partitions()
    assert len(reader.slices()) == 800 and mft.TASKS // 2 < len(parts) < 2 * mft.TASKS
    assert [s for g in parts for s in g.parts] == reader.slices()
    live = [n for g in parts for b in reader.read(g) for n in b.column("record_number").to_pylist()]
    rows = synthetic.rows(0, 2000)
    assert live == (~rows["zeroed"] & (rows["base_reference"] == 0)).nonzero()[0].tolist()
    few = mft.MftReader({"path": path, "recordsPerPartition": "3"})
    few.extents = lambda: [(f"{path}/part-000000000000.mft", 0, 0, 5 * 1024)]
    assert [len(g.parts) for g in few.partitions()] == [1, 1]
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index", "index")
    mft.index_names(spark, path)
    stages = [before.getStageInfo(i) for j in before.getJobIdsForGroup("index") for i in before.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= mft.TASKS and len(list((tmp_path / "image").glob("*.names"))) == 400


def test_whole_slices_share_tasks():
    slices = [mft.Slice(k * 65_536, 65_536, 0, f"part-{k}") for k in range(144)]
    groups = mft.dealt(slices)
    assert len(groups) == 36 and [p for g in groups for p in g.parts] == slices


def test_drives_are_scanned_at_once(spark, image, tmp_path, monkeypatch):
    """Two scans wait for each other; one drive's fault stays its own, and drives keep their order."""
    import threading

    for k in "CDE":
        usn_journal.append_segment(str(tmp_path / k), 7, 0, 10, [(6, 5, i, 1, 2, 0, "x") for i in range(10)])
    both, whole = threading.Barrier(2, timeout=60), paths.resolve_paths

    def resolve(*args, **kwargs):
        both.wait()
        return whole(*args, **kwargs)

    monkeypatch.setattr(paths, "resolve_paths", resolve)
    s = WatchSession(spark, str(tmp_path / "watch"))
    result = s.start([Drive("D", image, str(tmp_path / "D")), Drive("X", image, str(tmp_path / "none")), Drive("C", image, str(tmp_path / "C"))])
    assert list(result.scans) == ["D", "C"] == list(result.advanced) and list(result.errors) == ["X"]
    assert {k: v.where(f"path like '{k}:%'").count() for k, v in result.scans.items()} == {k: v.count() for k, v in result.scans.items()}
    assert result.scans["C"].count() > 700
    s.dispose()


def test_payload_is_encoded_and_read_a_batch_at_a_time(monkeypatch, tmp_path):
    monkeypatch.setattr(scan_payload, "BATCH_ROWS", 2)
    sizes = []
    whole = scan_payload.heap_of
    monkeypatch.setattr(scan_payload, "heap_of", lambda names, own: sizes.append(len(names)) or whole(names, own))
    rows = [(i, 5, i, i, 0x20, i % 2 == 0, f"n\u00fc{i}" * (i % 4), f"X:\\n{i}") for i in range(9)]
    done = scan_payload.PayloadWriter(str(tmp_path)).write(iter([payload(rows[:5]), payload(rows[5:])]))
    scan_payload.PayloadWriter(str(tmp_path)).commit([done])
    assert len(done.paths) == 1 and sizes == [2, 2, 1, 2, 2]
    reader = scan_payload.PayloadReader(str(tmp_path))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [2, 2, 2, 2, 1]
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert got == [(*r[:2], Decimal(r[2]), *r[3:]) for r in rows]
