import hashlib
from collections import Counter

from pyspark.sql import functions as F

from inodeon.llm import sketch

from .cases import awkward, frame


def shingles(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_against_brute_force(spark):
    rows = sorted(awkward(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in sketch.fingerprint_edits(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after, r = text or "", rows[(i + 1) % len(rows)][1] or "", got[doc_id]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest() and r.n_chars == len(text)
        assert abs(r.near_edited - alike(shingles(text), shingles(edit))) < 0.15
        assert abs(r.near_next - alike(shingles(text), shingles(after))) < 0.15
        assert len(r.fingerprint) == 16 * min(128, len(shingles(text)))


def against_order(spark, rows, bucket_rows):
    """Compares with the order of a plain sort; rows: (doc_id, text), the same text for equal doc_ids."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.text, r.next_text) for r in sketch.with_next(docs, bucket_rows).collect())
    down = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter((i, t, n) for (i, t), (_, n) in zip(down, down[1:] + down[:1]))
    assert got == want


def test_order_over_buckets_and_gaps(spark):
    text = lambda i: f"text of {i} and some more words"
    ids = [0, 1, 255, 256, 70_000, 70_001, 9_000_000, -5, 2**62, -(2**62)]
    against_order(spark, [(i, text(i)) for i in ids], 3)
    against_order(spark, [(5, "alone")], 4)
    hashed = [hash((i, "x")) for i in range(3000)]
    against_order(spark, [(i, text(i)) for i in hashed], 64)


def test_a_third_of_the_rows_alike(spark):
    rows = [(i * i, f"text {i}") for i in range(400)]
    against_order(spark, rows + [(77, "one id")] * 300 + [(None, "no id")] * 200 + [(3, "two")] * 2, 16)
    against_order(spark, [(None, "no id")] * 50, 4)


def test_merge_containment_and_count(spark):
    a, b = " ".join(f"a{i}" for i in range(2000)), " ".join(f"a{i}" for i in range(1000))
    df = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa"), "b", "sb")
    r = df.select(
        sketch.resemblance(F.col("sa"), F.col("sb")).alias("j"),
        sketch.containment(F.col("sb"), F.col("sa")).alias("c"),
        sketch.distinct_shingles(F.col("sa")).alias("n"),
        (sketch.merge(F.col("sa"), F.col("sb")) == F.col("sa")).alias("same"),
    ).first()
    assert abs(r.j - 0.5) < 0.15 and r.c > 0.8 and abs(r.n / 1996 - 1) < 0.3 and r.same


def test_repeated_and_empty(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1, "e", "k")] * 3 + [(None, "other", "en", "s", 1, "e", "k")]
    out = sketch.fingerprint_edits(frame(spark, rows)).collect()
    assert len(out) == 4
    assert sketch.fingerprint_edits(frame(spark, [])).count() == 0


def test_very_many_repeats_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sketch, "REPEATS", 16)
    rows = [(i * i, f"text {i}") for i in range(100)]
    against_order(spark, rows + [(77, "one id")] * 90 + [(None, "no id")] * 17 + [(3, "two")] * 16, 16)
    against_order(spark, [(None, "no id")] * 50, 4)


def test_texts_of_a_million_characters(spark):
    long = " ".join(f"word{i % 5000}x{i}" for i in range(90_000))
    rows = [(3, long, "en", "s", 1, "e", "k"), (2, long[: len(long) // 2], "en", "s", 1, "e", "k"), (1, "short", "en", "s", 1, "e", "k")]
    got = {r.doc_id: r for r in sketch.fingerprint_edits(frame(spark, rows)).collect()}
    half = len(long) // 2
    edit = long[: len(long) - half] + rows[1][1][:half]
    assert got[3].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest() and abs(got[3].near_next - alike(shingles(long), shingles(rows[1][1]))) < 0.15
