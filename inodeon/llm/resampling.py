"""Importance resampling towards a target distribution (operator 13).

A text's features are its runs of one and two words, hashed into ``BUCKETS`` buckets. The sparse document-by-bucket count matrix is
written once, as compressed-sparse-row blocks of a bounded number of entries. Its column sums, and those of the target's matrix, give both
distributions, and with them a gain for each bucket. The product of the matrix and the gains, divided by the features of each row, is the
weight. Adding Gumbel noise that depends on doc_id only and taking the highest scores draws without replacement in proportion to the
exponentials of the weights.

Rows of the matrix never leave their block; what is collected is two counts a bucket. Places in the order of scores are counted in ranges.

Edge cases: null, empty and wordless texts have no features and weight 0; repeated rows are rows of their own, each with its place; a row
without a doc_id draws its noise from the empty id and comes after others of its score; texts of any length are read a piece at a time; an empty
table gives an empty result, an empty target only smoothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import fresh_dir, in_order, small_batches, text_bytes

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
#: A block ends with the document that brings it to so many entries or rows.
BLOCK_ENTRIES = 65_536
BLOCK_ROWS = 1024
#: Words counted at once; longer texts go through in pieces.
PIECE = 65_536
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Of a block's rows the ids, the words and where their entries end; of its entries the buckets and the counts, as plain little-endian arrays.
BLOCK = "doc_ids array<long>, n_words array<long>, ends array<int>, buckets binary, counts binary"


def row_of(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of a text, and its row of the matrix: buckets in order and their counts."""
    crc = zlib.crc32
    found = (m[0] for m in _WORD.finditer(text.lower()))
    n, last, parts = 0, None, []
    while words := list(islice(found, PIECE)):
        ones = [crc(w) for w in words]
        twos = [crc(b" " + w, c) for c, w in zip(ones if last is None else [last, *ones], words[1:] if last is None else words)]
        n, last = n + len(words), ones[-1]
        parts.append(np.unique(np.array(ones + twos, dtype=np.uint32) % np.uint32(buckets), return_counts=True))
    if not parts:
        return 0, np.empty(0, np.int32), np.empty(0, np.int64)
    if len(parts) == 1:
        return n, parts[0][0].astype(np.int32), parts[0][1]
    total = np.zeros(buckets, dtype=np.int64)
    for at, count in parts:
        total[at] += count
    at = np.flatnonzero(total)
    return n, at.astype(np.int32), total[at]


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def count_matrix(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The matrix of ``docs`` (doc_id, text), as blocks: ids and words of the rows, where each row's entries end, and the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, ends, at, counts = [], [], [0], [], []

        def block() -> pa.RecordBatch:
            lists = [pa.array([v], pa.list_(kind)) for v, kind in ((ids, pa.int64()), (words, pa.int64()), (ends[1:], pa.int32()))]
            entries = [pa.array([np.concatenate(v).astype(kind).tobytes()]) for v, kind in ((at, _kind(buckets)), (counts, "<u4"))]
            return pa.RecordBatch.from_arrays([*lists, *entries], ["doc_ids", "n_words", "ends", "buckets", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, where, count = row_of(text.as_buffer().to_pybytes(), buckets)
                ids.append(doc_id)
                words.append(n)
                ends.append(ends[-1] + len(where))
                at.append(where)
                counts.append(count)
                if ends[-1] >= BLOCK_ENTRIES or len(ids) >= BLOCK_ROWS:
                    yield block()
                    ids, words, ends, at, counts = [], [], [0], [], []
        if ids:
            yield block()

    out = fresh_dir(docs.sparkSession, "count-matrix")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b")).mapInArrow(run, BLOCK).write.parquet(out)
    return docs.sparkSession.read.parquet(out)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The matrix's sums by bucket: one array of ``buckets`` numbers, whatever the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for at, counts in zip(batch.column(0), batch.column(1)):
                at, counts = np.frombuffer(at.as_buffer(), _kind(buckets)), np.frombuffer(counts.as_buffer(), "<u4")
                total += np.bincount(at, counts, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    total = np.zeros(buckets, dtype=np.int64)
    for row in matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's share of each bucket over the raw one, each count one higher, rounded down."""
    s_all, t_all = (float(x.sum() + len(raw)) for x in (raw, target))
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(raw, target)], dtype=np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the matrix times the gains, over the features of each row, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, ends = (batch.column(c)[k].values for c in range(3))
                at, counts = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((3, _kind(len(gain))), (4, "<u4")))
                sums = np.r_[0, np.cumsum(gain[at] * counts)][np.r_[0, ends.to_numpy()]]
                n = words.to_numpy()
                features = n + np.maximum(n - 1, 0)
                weight = np.where(n > 0, np.diff(sums) // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows with ``score``: the weight and thousandths of Gumbel noise keyed by seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per document ``(doc_id, n_features, weight, score, rank)``; of those with ``min_words`` words, ``percent`` of a hundred are drawn.

    ``target`` has a ``text``. rank numbers the drawn by falling score, then doc_id; it is null for the others.
    """
    with small_batches(docs.sparkSession):
        return _resample(docs, target, percent, min_words, seed)


def _resample(docs: DataFrame, target: DataFrame, percent: int, min_words: int, seed: int) -> DataFrame:
    matrix = count_matrix(docs)
    wanted = count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(column_sums(matrix), column_sums(wanted))
    rows = scored(weights(matrix, gain), seed).withColumns({"able": F.col("n_words") >= min_words, "tie": F.monotonically_increasing_id()})
    placed = in_order(rows, F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("tie"))
    drawn = percent * placed.where("able").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: Bytes' checksums go through a table of 256, a feature at a time.
ORACLE_SQL = r"""
WITH powers AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) AS c FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split
), per_row AS (
  SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, tab[1 + xor(c & 255, b)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM per_row), powers
), entries AS (
  SELECT side, r, bucket, n FROM per_row JOIN hashed USING (f)
), sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN entries e ON e.bucket = b.bucket GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM sums
), weighed AS (
  SELECT r, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM entries JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (r) WHERE side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS total FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * total // 100 THEN place END AS rank FROM placed
"""
