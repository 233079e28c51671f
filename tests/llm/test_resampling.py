import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from inodeon.llm import resampling

from .cases import awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target):
    raw, wanted = [0] * 10_000, [0] * 10_000
    found = [(doc_id, *features(text)) for doc_id, text in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    for _, _, fs in found:
        for f in fs:
            raw[bucket(f)] += 1
    for text in target:
        for f in features(text)[1]:
            wanted[bucket(f)] += 1
    s_all, t_all = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(raw, wanted)]
    rows = []
    for doc_id, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 25 * len(able) // 100]
    ranks = {}
    for k, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(k)
    return [(*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows]


def check(spark, docs, target):
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, target)))


def test_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in awkward(120)]
    check(spark, docs, ["w1 w2 w3 w4", None, "", "élan W5-w6 naïve 77"])
    check(spark, docs[:40] + [(None, docs[30][1])] * 3 + [docs[20]] * 4, [])


def test_texts_in_pieces_are_counted_as_one(monkeypatch):
    text = " ".join(f"a{i % 97} É{i}.b" for i in range(3000))
    whole = resampling.row_of(text.encode())
    monkeypatch.setattr(resampling, "PIECE", 7)
    n, at, counts = resampling.row_of(text.encode())
    assert n == whole[0] == len(features(text)[0]) and (at == whole[1]).all() and (counts == whole[2]).all() and counts.sum() == len(features(text)[1])


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in awkward(60)]
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 50)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 3)
    check(spark, docs, ["w1 w2 w3 w4"])


def test_empty_tables_and_extra_columns(spark):
    target = spark.createDataFrame([("w1 w2",)], "text string")
    assert resampling.resample(frame(spark, []), target).count() == 0
    names = ("weight", "score", "rank", "place", "able", "tie", "b", "n_words", "counts", "ends")
    a, b = (sorted(map(str, resampling.resample(d, target).collect())) for d in (frame(spark), frame(spark).withColumns({n: F.lit("own") for n in names})))
    assert a == b and len(a) == len(awkward())


def test_a_long_text(spark):
    long = " ".join(f"word{i % 900}" for i in range(200_000))
    check(spark, [(1, long), (2, "short text"), (3, " ".join(f"w{i}" for i in range(30)))], ["word1 word2"])
