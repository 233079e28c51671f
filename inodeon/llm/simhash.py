"""SimHash near-duplicate groups (operator 10).

Fingerprints of 64 bits link when at most ``MAX_BITS`` = 3 bits differ. Three bits touch at most three of the eight
bytes, so a linked pair shares at least five (position, byte) entries. The inverted index therefore lists every
distinct fingerprint under its 56 combinations of five positional bytes: two fingerprints meet in a posting exactly
when their tally of shared positional bytes reaches the guaranteed minimum of five, and no posting list of a
single, common byte is ever paired up. Within a posting all pairs are verified on the remaining 24 bits, in blocks, and
only a spanning star of each linked set is emitted, so copies never become all pairs. A posting holds at most 2**24
different fingerprints by construction.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows and equal texts
share a fingerprint and thus a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import cut, map_arrow, text_bytes, text_hash
from inodeon.llm.graph import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Postings up to this size are verified pair by pair, so many pairs at once; larger ones by looking up each one's ball.
PAIRWISE = 8192
CELLS = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles (repeats included) of a UTF-8 text; A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        grams = [digest(b" ".join(words), SEED)]
    else:
        grams = [digest(b" ".join(gram), SEED) for gram in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(grams), 65536):
        part = np.frombuffer(b"".join(grams[start : start + 65536]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """``(doc_id, fp)``, with ``text_hash`` between them if asked for: fp holds the 64 bits in a long."""
    keys = ["doc_id", *(["text_hash"] if hashed else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(len(keys))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found.view(np.int64))], [*keys, "fp"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), text_bytes().alias("b"))
    return map_arrow(rows.select(*keys, "b"), run, ", ".join(f"{c} long" for c in (*keys, "fp")))


def postings(fps: DataFrame) -> DataFrame:
    """The inverted index ``(combo, shared, fp)``: each fingerprint under its combinations of guaranteed matches."""
    keep = 8 - MAX_BITS
    entries = []
    for i, combo in enumerate(combinations(range(8), keep)):
        mask = sum(0xFF << (8 * p) for p in combo)
        mask -= (mask >> 63) << 64
        entries.append(F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(mask)).alias("shared")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.combo", "e.shared", "fp")


def _stars(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (centre, member) of the sets linked within one posting; values are distinct and sorted."""
    n = len(values)
    label = np.arange(n)
    masks = [] if n <= PAIRWISE else [sum(np.uint64(1) << np.uint64(b) for b in bits) for bits in _balls(values)]
    while True:
        new = label.copy()
        if n <= PAIRWISE:
            step = max(1, CELLS // n)
            for s in range(0, n, step):
                near = np.bitwise_count(values[s : s + step, None] ^ values[None, :]) <= MAX_BITS
                new[s : s + step] = np.where(near, label[None, :], n).min(axis=1)
        for mask in masks:
            at = np.minimum(np.searchsorted(values, values ^ mask), n - 1)
            hit = values[at] == values ^ mask
            new[hit] = np.minimum(new[hit], label[at[hit]])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return values[label[member]], values[member]


def _balls(values: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Bit sets of up to MAX_BITS among the bits in which the values differ at all."""
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    for size in range(1, MAX_BITS + 1):
        yield from combinations(bits, size)


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect the same sets as all pairs within MAX_BITS would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def edges(combo: np.ndarray, shared: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (combo[1:] != combo[:-1]) | (shared[1:] != shared[:-1])])
            lengths = np.diff(np.r_[starts, len(fp)])
            two = starts[lengths == 2]
            ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS
            left, right = [fp[two[ok]]], [fp[two[ok] + 1]]
            for s, n in zip(starts[lengths > 2], lengths[lengths > 2]):
                a, b = _stars(np.sort(fp[s : s + n]))
                left.append(a)
                right.append(b)
            out = [np.concatenate(x).view(np.int64) for x in (left, right)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            last = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
            whole = int(np.argmax(last))  # the last posting may go on in the next batch
            if whole:
                yield edges(*(x[:whole] for x in rest))
                rest = [x[whole:] for x in rest]
        if rest:
            yield edges(*rest)

    index = postings(fps).repartition("combo", "shared").sortWithinPartitions("combo", "shared")
    return index.mapInArrow(run, "a long, b long").distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """``(fp, first, root)`` from the distinct fingerprints ``(fp, first)``; those that links connect have one root."""
    roots = connected_components(links(nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` from ``(doc_id, fp)``; component_id is the smallest doc_id reachable by links."""
    named = _rooted(cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document ``(doc_id, fingerprint, component_id)``; the fingerprint as 16 lowercase hex digits."""
    found = components(cut(fingerprints(docs, shingle)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id, then hash of the text.

    Of repeated rows of that doc_id and text any one stays. One doc_id on unrelated texts stays with each component of which it is the
    smallest; rows without a doc_id all stay.
    """
    prints = cut(fingerprints(docs, shingle, hashed=True))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    named = _rooted(cut(prints.groupBy("fp").agg(F.min(known).alias("first"))))
    first = named.groupBy("root").agg(F.min("first").alias("first")).where("first is not null")
    kept = cut(first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")))
    key = text_hash(docs["text"])
    out = docs.join(kept, (docs["doc_id"] == kept["doc_id"]) & (key == kept["text_hash"]), "left_semi")
    if not prints.join(kept, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        # a row's own columns travel in one struct, so that none can clash with the key
        rows = out.select("doc_id", text_hash().alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        out = rows.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    if not prints.where("doc_id is null").isEmpty():
        out = out.unionByName(docs.where("doc_id is null"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
