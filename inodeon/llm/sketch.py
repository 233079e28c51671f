"""Bottom-k sketches of word-shingle hashes as document fingerprints (operator 5).

A sketch holds the ``K`` smallest of a text's distinct shingle hashes (five words; a shorter text is one shingle, an empty
one has none). It is a plain ``array<long>`` in ascending order, so sketches of parts merge by taking the K smallest of
their union, and three estimates follow from one or two sketches: resemblance, containment and the number of distinct shingles. All of
it is DataFrame expressions; a sketch of fewer than K hashes is complete and its estimates are exact.

Neighbours in the order of ids are found without a global sort of texts. Rows of one doc_id and text are one row with a number at first. Their keys
alone are put in order, in ranges that Spark draws, and get numbers; every ``BUCKET_ROWS`` numbers are a bucket, and the text of each bucket's first
row also goes to the bucket before. So buckets have a bounded number of rows whatever the input, however sparse, dense or repeated the ids.

Edge cases: a null text counts as empty; two empty sketches have resemblance 1, an empty and a non-empty one 0; equal
texts have equal sketches; repeated rows are rows of their own; rows of one doc_id are ordered among themselves by a hash of the text; an empty
table gives an empty result; other columns are ignored. Rows without a doc_id come last in the descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inodeon.llm.common import in_order, text_hash

SHINGLE = 5
K = 128
#: Different rows of a bucket, and repeats of a row that one task makes at once.
BUCKET_ROWS = 64
REPEATS = 1024
_WHITE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, _WHITE, -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def with_sketch(rows: DataFrame, text: str, into: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """The rows with the bottom-k sketch of a text column; the word hashes are a column of their own, computed once."""
    rows = rows.withColumn("_words", word_hashes(F.col(text)))
    n = F.size("_words")
    grams = F.transform(
        F.when(n >= shingle, F.sequence(F.lit(0), n - shingle)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get("_words", i + j) for j in range(shingle))),
    )
    short = F.when(n > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<long>"))
    hashes = F.when(n >= shingle, grams).otherwise(short)
    return rows.withColumn(into, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the distinct shingles of both that they have in common."""
    common = F.size(F.array_intersect(F.array_intersect(merge(a, b, k), a), b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / F.least(F.size(F.array_union(a, b)), F.lit(k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def written(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, in order."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, d, h)``: in ascending order of (d, h) the doc_ids fall."""
    at = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"d": at, "h": text_hash("text")})


def _successors(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """The different rows ``(doc_id, text, sk)`` with next_text and next_sk, those of the next row in descending order of doc_id, around the end.

    ``times`` says how many rows each of these is: a row that is there n times is followed by its like n - 1 times.
    """
    rows = _keyed(docs)
    order = in_order(rows.groupBy("d", "h").agg(F.count("*").alias("n")), F.col("d"), F.col("h"))
    total, most = order.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    order = order.drop("n")
    different = rows.groupBy("d", "h").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    at = F.col("place") - 1
    bucket = F.floor(at / bucket_rows)
    spot = lambda b, p, ghost: F.struct(b.cast("long").alias("bucket"), p.cast("long").alias("at"), F.lit(ghost).alias("ghost"))
    head = F.when((at % bucket_rows == 0) & (at > 0), F.array(spot(bucket - 1, at, True))).when(at == 0, F.array(spot(F.lit((max(total, 1) - 1) // bucket_rows), F.lit(total), True)))
    spots = F.concat(F.array(spot(bucket, at, False)), F.coalesce(head, F.array().cast("array<struct<bucket:long,at:long,ghost:boolean>>")))
    dealt = different.join(order, ["d", "h"]).select("doc_id", "text", "n", F.explode(spots).alias("spot")).select("doc_id", "text", "n", "spot.*")
    # sketches are made where rows arrive, so that they don't travel
    every = with_sketch(dealt.repartition("bucket"), "text", "sk")
    by = Window.partitionBy("bucket").orderBy("at")
    nexts = every.withColumns({"next_text": F.lead("text").over(by), "next_sk": F.lead("sk").over(by)})
    alike = F.struct(F.col("text").alias("next_text"), F.col("sk").alias("next_sk"), (F.col("n") - 1).alias("times"))
    after = F.struct("next_text", "next_sk", F.lit(1).cast("long").alias("times"))
    ways = F.when((F.col("n") > 1) & (F.col("n") <= REPEATS), F.array(after, alike)).otherwise(F.array(after))
    found = nexts.where("not ghost").select("doc_id", "text", "sk", F.explode(ways).alias("way")).select("doc_id", "text", "sk", "way.*")
    if most <= REPEATS:
        return found
    # what is there very often is dealt out in parts
    often = different.where(F.col("n") > REPEATS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / REPEATS))))
    often = often.withColumn("times", F.least(F.lit(REPEATS).cast("long"), F.col("n") - 1 - F.col("part") * REPEATS)).repartition("part", "d", "h")
    often = with_sketch(often, "text", "sk")
    return found.unionByName(often.select("doc_id", "text", "sk", F.col("text").alias("next_text"), F.col("sk").alias("next_sk"), "times"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as many times as its ``times`` says."""
    return rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("k", "times")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows ``(doc_id, text, sk)`` with next_text and next_sk, those of the next row in descending order of doc_id, around the end.

    Of rows with equal doc_id and text, which are alike, all but one are followed by their like.
    """
    return _repeated(_successors(docs, bucket_rows))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the following text's start."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike it finds the edited and the next text."""
    rows = _successors(docs.select("doc_id", "text"), BUCKET_ROWS)
    rows = with_sketch(rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))), "edited", "edited_sk")
    made = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sk")).alias("fingerprint"),
        written(F.col("edited_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk")).alias("near_next"),
        "times",
    )
    return _repeated(made)
