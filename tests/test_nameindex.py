import random

import pytest

from inodeon.model import MatchFlags
from inodeon.sources import mft, nameindex

SCHEMA = "record_number long, parent_record_number long, flags int, file_attributes long, file_name string"


@pytest.mark.parametrize("per_entry", [64, 100, 8192])
def test_searches_lose_nothing_and_skip_much(spark, tmp_path, per_entry):
    rng = random.Random(5)
    rows = [(5, 5, 3, 16, ".")] + [(i, 5, 1, 32, f"{rng.choice(['Report', 'photo', 'Ünï', 'x'])}-{i // 50:04d}-{i}.{rng.choice(['txt', 'JPG', 'md'])}") for i in range(6, 6000) if i % 7]
    path = str(tmp_path / "image")
    mft.write_records(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), path, 1500)
    plain = {r.record_number: r.file_name for r in mft.read_image(spark, path).collect()}
    assert plain == {n: name for n, *_, name in rows}
    mft.index_names(spark, path, per_entry)
    for text, flags in (("report-0003-157.TXT", MatchFlags.EXACT), (rows[-1][4], MatchFlags.EXACT), ("none of them", MatchFlags.EXACT), ("-0099-", MatchFlags.CONTAINS), ("Ünï-00", MatchFlags.CONTAINS), ("t", MatchFlags.CONTAINS), ("", MatchFlags.CONTAINS), ("zzzz", MatchFlags.CONTAINS)):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        fold = {n: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name) for n, name in plain.items()}
        found, seen = mft.search_image(spark, path, text, flags, recordsPerPartition=per_entry * 8)
        got = {r.record_number for r in found.collect()}
        assert got == {n for n, f in fold.items() if (f == low if flags & MatchFlags.EXACT else low in f)}, text
        if text in ("none of them", "zzzz", "-0099-") and per_entry < 200:
            assert seen.get["total_records"] < 1000
    # slices that don't begin with an entry are read whole
    found, _ = mft.search_image(spark, path, rows[-1][4], recordsPerPartition=77)
    assert found.count() == 1
    with pytest.raises(ValueError, match="volume"):
        mft.index_names(spark, path, layout="volume")


def test_entry_of_a_chunk_without_names():
    import pyarrow as pa

    none = nameindex.entry(pa.array([], pa.string()))
    assert len(none) == nameindex.ENTRY and not nameindex.Search("a", True).possible(none) and not nameindex.Search("", False).possible(none)
    some = nameindex.entry(pa.array(["b", "c" * 50]))
    assert nameindex.Search("b", True).possible(some) and nameindex.Search("c" * 50, True).possible(some) and not nameindex.Search("d", True).possible(some)
