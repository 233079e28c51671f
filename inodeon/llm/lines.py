"""Document quality from line labels of a conditional random field (operator 9).

A linear chain over a document's lines labels every line good or bad from its own and its neighbours' features. The field
is trained on a bounded sample of labelled documents outside the held-out fold, each line bearing its document's label. A
document's score is the mean of its lines' forward-backward marginals for good, weighted by their length.

Edge cases: a null text counts as empty; an empty text is one line of no length and gets that line's marginal; repeated rows
get equal scores; of contradicting labels of one document the lower counts; without any usable labels every score is 0.5;
an empty documents table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm import crf
from inodeon.llm.common import map_arrow, text_bytes

FOLDS = 5
THRESHOLD = 0.3
#: At most so many labelled documents, those with the smallest hashes, are used for training, if they have at most so many lines.
TRAIN_ROWS = 4000
TRAIN_LINES = 400
SEED = 7
#: Bytes of text whose lines are scored at once.
CHUNK = 4 << 20

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[list(b" \t\x0b\f\r")] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x61:0x7B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[list(b"#*$%&|<>")] = 5
_CLASS[list(b".,;:?")] = 6
_CLASS[list(b"!")] = 7
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9
_CLASSES = 11  # 0: other ASCII, 10: unused


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line (own, previous, next), weights by line, and lines by text."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    flat = [line for own in lines for line in own]
    sizes = np.array([len(x) for x in flat], dtype=np.int64)
    buffer = np.frombuffer(b"".join(flat), dtype=np.uint8)
    owner = np.repeat(np.arange(len(flat)), sizes)
    tally = np.bincount(owner * _CLASSES + _CLASS[buffer], minlength=len(flat) * _CLASSES).reshape(-1, _CLASSES).astype(np.float64)
    chars = sizes - tally[:, 9]
    words = np.zeros(len(flat))
    fresh = np.ones(len(flat))
    seen_before = np.zeros(len(flat))
    at = 0
    for own in lines:
        seen: set[bytes] = set()
        for line in own:
            found = line.split()
            if found:
                words[at] = len(found)
                fresh[at] = len(set(found)) / len(found)
                if line in seen:
                    seen_before[at] = 1.0
                seen.add(line)
            at += 1
    base, per_word = np.maximum(chars, 1), np.maximum(words, 1)
    own = np.stack(
        [
            np.log1p(chars),
            np.log1p(words),
            np.minimum(chars / per_word, 40),
            tally[:, 2] / base,
            np.minimum(tally[:, 2] / per_word, 5),
            tally[:, 4] / base,
            np.minimum(tally[:, 5] / per_word, 4),
            np.minimum(tally[:, 6] / per_word, 3),
            np.minimum(tally[:, 7] / per_word, 3),
            tally[:, 8] / base,
            fresh,
            fresh * np.log1p(words),
            seen_before,
            tally[:, 5] > 0,
            words == 0,
        ],
        axis=1,
    )
    first = np.zeros(len(flat), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(len(flat), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = own[first], own[last]  # a line at the edge stands for its missing neighbour
    return np.concatenate([own, before, after, first[:, None], last[:, None]], axis=1), chars + 1.0, counts


def _chunks(texts: list[bytes]) -> list[slice]:
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            out.append(slice(start, i))
            start, size = i, 0
        size += len(t)
    return [*out, slice(start, len(texts))]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, quality, text)`` of the bounded sample: both classes alike, those with the smallest hashes."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("draw", F.xxhash64("doc_id", F.lit(SEED)))
    picked = [known.where(F.col("quality") == q).orderBy("draw", "doc_id").limit(rows // 2) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1]).drop("draw")
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fits = F.length("text") - F.length(F.replace("text", F.lit("\n"))) < TRAIN_LINES
    return body.join(F.broadcast(sample), "doc_id").where(fits).orderBy("doc_id", "text").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> crf.Model | None:
    """The field, trained on the driver from the sample; None where the labels don't show both classes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
        features, _, counts = line_features(texts)
        ends = np.cumsum(counts) * features.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(features.astype(np.float32).ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), lists], ["doc_id", "quality", "n_lines", "features"])

    sample = training_rows(docs, labels, rows).select("doc_id", text_bytes().alias("b"), F.col("quality").cast("int"))
    got = map_arrow(sample, run, "doc_id long, quality int, n_lines long, features array<float>", 256).toArrow()
    quality = got.column("quality").to_numpy()
    if len(set(quality.tolist())) < 2:
        return None
    lengths = got.column("n_lines").to_numpy()
    flat = got.column("features").combine_chunks().flatten().to_numpy().astype(np.float64)
    return crf.train(flat.reshape(int(lengths.sum()), -1), np.repeat(quality, lengths), lengths)


def scores(texts: list[bytes], model: crf.Model | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    features, weight, counts = line_features(texts)
    good, _, _ = crf.marginals(model.emissions(features), model.transitions, crf.Chains(counts))
    starts = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(good[:, 1] * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def score(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
        found = np.concatenate([scores(texts[part], model) for part in _chunks(texts)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    out = map_arrow(docs.select("doc_id", text_bytes().alias("b")), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
