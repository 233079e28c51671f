"""MinHash near-duplicate groups by fast similarity sketching (operator 11).

A sketch has ``COORDINATES`` places. In round i of the first so many, every shingle of the set is hashed to a place and a value; a place takes
the smallest value of the first round that reaches it. Rounds of the second half send all shingles to one place each, so that every
place is filled after twice as many rounds at the latest; sets of more than some thousand shingles need one round. Two sets agree at each
place with the probability of their resemblance, and the share of places that agree is concentrated about it as that of independent hashes.

``BANDS`` bands of ``ROWS`` places make buckets. A pair at the threshold of 0.85 meets in none of them with a probability of 3 in
a million, one of 0.9 in 2 of ten thousand million, and one of 0.4 meets in one of forty cases. Links are confirmed on the pair's full sets. Only
what connects is looked for: members of a bucket are compared with its hub, the one that shares most buckets with others, and after that only those that
are still in different components with each other; so copies don't become all pairs, and no pair that shares a bucket and could join two components
is left out, but for those that agree at so few places of their sketches as one in a million pairs at the threshold does.

A text's identity is its MD5, a shingle's 64 bits made of its words' hashes.

Edge cases: null, empty and wordless texts have no shingle and stay alone; texts of fewer than five words are one shingle; repeated rows
and equal texts are in one component; rows without a doc_id don't count for the smallest one, a component of only such rows has a null one, and its
rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import fresh_dir, map_arrow, small_enough, text_bytes
from inodeon.llm.graph import connected_components

SHINGLE = 5
#: A link takes so many hundredths of the union in common.
PERCENT = 85
ROWS, BANDS = 8, 40
COORDINATES = ROWS * BANDS
SEED = 11
#: Bits of each place by which sketches are compared as wholes, and how likely a pair at the threshold is thrown out by that.
PLANES = 4
MISS = 1e-6
WORDS = -(-COORDINATES // 64)
#: Keys of texts, 16 bytes each, that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
_PART = 65_536
_FULL = np.uint64(2**64 - 1)
_LOW, _32 = np.uint64(2**32 - 1), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles of a UTF-8 text, sorted; A-Z are lower-cased."""
    words = text.lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = len(hashed) - shingle + 1
    grams = hashed[:n]
    for j in range(1, shingle):
        grams = _mixed(grams + np.uint64(j)) ^ hashed[j : j + n]
    return np.unique(_mixed(grams))


def sketch(hashes: np.ndarray, size: int = COORDINATES, seed: int = SEED) -> np.ndarray:
    """The sketch of a set of hashes that isn't empty: at each place its round in the upper, its value in the lower 32 bits."""
    salts = _mixed(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = np.full(size, _FULL)
    at_once = max(1, 1024 // len(hashes))
    for first in range(0, size, at_once):
        rounds = np.arange(first, min(first + at_once, size), dtype=np.uint64)
        for s in range(0, len(hashes), _PART):
            y = _mixed(hashes[None, s : s + _PART] ^ salts[rounds][:, None])
            np.minimum.at(out, ((y >> _32) * np.uint64(size) >> _32).ravel(), ((rounds << _32)[:, None] | (y & _LOW)).ravel())
        if not (out == _FULL).any():
            return out
    for place in np.flatnonzero(out == _FULL):
        i = np.uint64(size + place)
        out[place] = (i << _32) | min((_mixed(hashes[s : s + _PART] ^ salts[i]) & _LOW).min() for s in range(0, len(hashes), _PART))
    return out


def buckets(places: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A number for each band of a sketch and what it holds."""
    bands = places.reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ bands[:, k])
    return out


def planes(places: np.ndarray) -> np.ndarray:
    """Some bits of each place, as bit sets: the first bit of all places in the first words, and so on."""
    low = _mixed(places)
    bits = np.zeros((PLANES, 64 * WORDS), dtype=np.uint8)
    for k in range(PLANES):
        bits[k, : len(places)] = low >> np.uint64(k) & np.uint64(1)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def least_agreement(size: int = COORDINATES) -> int:
    """At how many places a pair at the threshold agrees at least, but for a chance of ``MISS``."""
    p = PERCENT / 100 + (1 - PERCENT / 100) / 2**PLANES
    below, k = 0.0, 0
    while (below := below + math.comb(size, k) * p**k * (1 - p) ** (size - k)) <= MISS:
        k += 1
    return k


def _agree(a: Column, b: Column) -> Column:
    """Whether two sketches agree at enough places to be looked at."""
    differ = F.lit(0)
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for k in range(PLANES):
            word = word.bitwiseOR(F.get(a, F.lit(k * WORDS + w)).bitwiseXOR(F.get(b, F.lit(k * WORDS + w))))
        differ = differ + F.bit_count(word)
    return differ <= COORDINATES - least_agreement()


def _sketched(docs: DataFrame) -> DataFrame:
    """``(doc_id, tid, n, buckets, planes)`` of every row, written once: the text's identity, the size of its set, the buckets, and bits of the sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t.as_buffer().to_pybytes()) for t in batch.column(2)]
        places = [sketch(s) if len(s) else None for s in sets]
        found = [pa.array([None if p is None else of(p).view(np.int64) for p in places], pa.list_(pa.int64())) for of in (buckets, planes)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *found], ["doc_id", "tid", "n", "buckets", "planes"])

    out = fresh_dir(docs.sparkSession, "sketches")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _identity(), text_bytes().alias("b"))
    map_arrow(rows, run, "doc_id long, tid binary, n long, buckets array<long>, planes array<long>").write.parquet(out)
    return docs.sparkSession.read.parquet(out)


def _identity() -> Column:
    return F.unhex(F.md5(text_bytes())).alias("tid")


def _sizes_allow(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _written(df: DataFrame, name: str) -> DataFrame:
    out = fresh_dir(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cid, hashes)``, written once: the full sets of the texts ``(tid, cid)`` that are wanted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes(t.as_buffer().to_pybytes()).view(np.int64) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["cid", "hashes"])

    keyed = docs.select(_identity(), text_bytes().alias("b"))
    chosen = keyed.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_KEYS) else wanted, "tid")
    return _written(map_arrow(chosen.groupBy("cid").agg(F.first("b").alias("b")), run, "cid long, hashes array<long>"), "sets")


def _resemble(a: str, b: str) -> Column:
    """Whether two full sets have enough in common; their hashes are distinct."""
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= PERCENT * (F.size(a) + F.size(b) - common)


def _apart(crowded: DataFrame, known: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of texts that share a bucket, are not its hub and are in different components.

    Most members of a bucket are in one component, the others are compared with them and with each other; of all that is compared
    only the links leave the join.
    """
    rows = crowded.join(known.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root")
    rest = rows.where("cid <> hub").select("bucket", "cid", "n", "label")
    counts = rest.groupBy("bucket", "label").agg(F.count("*").alias("members"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("members", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    rest = rest.join(main, "bucket").withColumn("odd", F.col("label") != F.col("main")).drop("main")
    rest = _written(rest, "apart").join(sketches, "cid").join(sets, "cid")
    odd = rest.where("odd").select("bucket", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("planes").alias("planes_a"), F.col("hashes").alias("hashes_a"))
    open_ = (F.col("label") != F.col("label_a")) & (~F.col("odd") | (F.col("a") < F.col("cid")))
    pairs = odd.join(rest, (odd["bucket"] == rest["bucket"]) & open_ & _sizes_allow("n", "n_a") & _agree(F.col("planes"), F.col("planes_a")) & _resemble("hashes", "hashes_a"))
    return _written(pairs.select("a", F.col("cid").alias("b")).distinct(), "links")


def _components(crowded: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, root)`` of all texts that a confirmed link joins to others; crowded are the rows of buckets with several texts."""
    pairs = crowded.where((F.col("cid") != F.col("hub")) & _sizes_allow("n", "hub_n")).select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    full = sets.join(sketches, "cid")
    pairs = pairs.join(full.select(F.col("cid").alias("b"), F.col("planes").alias("planes_b"), F.col("hashes").alias("hashes_b")), "b")
    pairs = pairs.join(full.withColumnRenamed("cid", "a"), "a").where(_agree(F.col("planes"), F.col("planes_b")) & _resemble("hashes", "hashes_b"))
    links = _written(pairs.select("a", "b"), "links")
    known = connected_components(links)
    more = _apart(crowded, known, sketches, sets)
    if more.isEmpty():
        return known
    # the components are joined by the few links that are left
    roots = known.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").withColumn("root", F.col("node")))
    ends = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
    joined = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document ``(doc_id, n_shingles, component_id, kept)``."""
    rows = _sketched(docs)
    # texts are numbered once, in a table that all later steps read
    classes = rows.where("n > 0").groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("buckets").alias("buckets"), F.first("planes").alias("planes"))
    classes = _written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    entries = classes.select(F.explode("buckets").alias("bucket"), "cid", "n")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = _written(entries.join(sizes, "bucket"), "buckets")
    ranked = shared.join(shared.groupBy("cid").agg(F.sum("members").alias("shares")), "cid")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("shares", "cid", "n")).alias("top"))
    crowded = _written(shared.drop("members").join(hubs.select("bucket", F.col("top.cid").alias("hub"), F.col("top.n").alias("hub_n")), "bucket"), "hubs")
    wanted = _written(classes.join(crowded.select("cid").distinct(), "cid", "left_semi").select("tid", "cid"), "wanted")
    known = _components(crowded, classes.select("cid", "planes"), _sets(docs, wanted))
    named = classes.select("tid", "cid", "first_id").join(known.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_text = named.join(smallest, "root").select("tid", "component_id")
    linked = rows.where("n > 0").select("doc_id", "tid", "n").join(of_text, "tid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def miss_probability(resemblance: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """How likely a pair of that resemblance meets in no bucket."""
    return math.pow(1 - resemblance**rows, bands)


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split
), sizes AS (
  SELECT r, count(*) AS n FROM grams GROUP BY 1
), shared AS (
  SELECT a.r AS a, b.r AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT r AS a, r AS b FROM split UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), smallest AS (
  SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN split ON split.r = reach.b GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM split JOIN smallest USING (r) LEFT JOIN sizes USING (r)
"""
