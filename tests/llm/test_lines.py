import random
import zlib

import pytest

from inodeon.llm import lines

from .cases import awkward, frame


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
        out = []
        good = i % 4 > 0
        for _ in range(rng.randint(1, 8)):
            words = [word() for _ in range(rng.randint(4, 15))]
            out.append(" ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" if i % 8 else w + "###" for w in words))
        docs.append((i, "\n".join(out), "en", "s", 1, "e", "k"))
        labels.append((i, int(good), 0))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return dict(labels=dict((i, q) for i, q, _ in labels), rows=lines.classify(frame(spark, docs), lab).collect())


def test_held_out_accuracy(scored):
    held = [r for r in scored["rows"] if r.held_out]
    assert len(scored["rows"]) == 600 and len(held) > 80
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored["rows"])
    assert sum(r.predicted == scored["labels"][r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored["rows"])


def test_held_out_labels_have_no_influence(spark):
    docs, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    out = []
    for lab in (labels, flipped):
        df = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
        out.append({r.doc_id: r.score for r in lines.classify(frame(spark, docs), df).collect()})
    assert out[0] == out[1]


def test_awkward_rows_and_missing_labels(spark):
    rows = awkward()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in lines.classify(frame(spark, rows), none).collect()} == {0.5}
    docs, labels = corpus(100)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = lines.classify(frame(spark, rows + [(None, "x", None, None, None, "e", "k")] + [(10_000 + r[0], *r[1:]) for r in docs]), spark.createDataFrame([(10_000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int"))
    assert got.count() == len(rows) + 101 and got.where("score is null or isnan(score)").count() == 0
    assert lines.classify(frame(spark, []), lab).count() == 0
