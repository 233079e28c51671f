import hashlib

from inodeon.llm import warc

PAGES = "page_id long, url string, html string, extra string"


def expected(rows):
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and top[h or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    return sorted(out)


def awkward():
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\n"
    bodies = [None, "", "short", "é" * 700, "x" * 1500, "x" * 1500, "x" * 999, "x" * 999, "tail WARC/1.0\r\n", "WARC/1.", "a" + fake.format(5) + "hello\r\n\r\n" + "b" * 1200]
    bodies += [fake.format(10**9) + "never", fake.format(0) + "\r\n\r\n" + fake.format(3) + "abc\r\n\r\n", "\r\n\r\nWARC/1.1\r\n\r\n", bodies[-1], "line\nline\r\n" * 200]
    # a false record inside that ends exactly where its host does, so that its successor is a true one
    bodies.append("q" * 50 + fake.format(40) + "z" * 40)
    urls = ["http://a.b/c", None, "http://x/\r\nContent-Length: 3", "http://y/WARC/1.0", "http://z/%25"]
    rows = [(i, urls[i % len(urls)], b, "e") for i, b in enumerate(bodies)]
    rows += [(100 + i, "http://p/", f"<html>{i % 7}" + "filler " * 300, "e") for i in range(25)]
    return rows


def test_round_trip_rejects_false_records(spark):
    rows = awkward()
    for parts in (1, 3):
        pages = spark.createDataFrame(rows, PAGES).repartition(parts)
        got = sorted(tuple(r) for r in warc.page_records(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        assert got == expected(rows)


def test_splits_inside_records(spark, tmp_path):
    rows = awkward()
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", "16k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = warc.read(spark, path)
            assert found.count() == len(rows)
            assert found.where("kind = 'response' and concat('sha1:', sha1) <> digest").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_chain_by_pointer_jumping(spark):
    true = [(f, 100 * i, 100 * (i + 1)) for f in ("a", "b") for i in range(200)]
    false = [("a", 100 * i + 50, 100 * (i + 3)) for i in range(0, 190, 3)] + [("a", 100 * i + 60, 100 * i + 61) for i in range(0, 190, 5)] + [("c", 7, 100), ("c", 100, 200)]
    df = spark.createDataFrame(true + false, "file string, off long, succ long")
    assert sorted((r.file, r.off, r.succ) for r in warc.verify(df).collect()) == sorted(true)


def test_empty_table_and_repeated_rows(spark):
    assert warc.page_records(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, "u", "y" * 2000, "e")] * 2 + [(None, "u", "y" * 2000, "e")]
    got = warc.page_records(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 1), (1, "response", 0), (1, "response", 0)]
