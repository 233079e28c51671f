"""Repeated passages by sparse suffix arrays (operator 7).

Suffixes are kept only where content selects them: at the word positions whose hash of the next ``GRAM`` words is smallest in some
window of ``WINDOW`` positions (minimisers). Equal passages select equal positions, and any passage of ``MIN_WORDS``
words holds a kept suffix that shares its first ``REACH`` = MIN_WORDS - WINDOW + 1 words. Suffixes whose first words no other one shares drop out
by a count. The rest are sorted by their first words and then by what follows; runs of neighbours that agree on so many following words
are compared on the words before, so that every match is extended to both sides by up to ``SIDE`` = WINDOW - 1 words, as far as
the next kept suffix. It counts if it has MIN_WORDS words or more and is in two documents. The union of a document's matches are its repeated
spans.

Equal suffixes (as far as extensions reach) are one class with its smallest and largest doc_id, pre-aggregated before any shuffle
by content, so that a passage in many documents is one entry of the array. Where more than ``CROWD`` classes share their first words, because a
common passage ends there, the same comparison is done by counting keys instead, which spreads them over all tasks.

Words count as equal if their 64-bit hashes are. The first comparison looks at 16 bits of the words around the first ones, and may thus
take classes for alike that aren't. What it finds is settled by a second one: classes in two documents match by themselves; for the others, and
those that share their first words, the whole hashes of the words around them are taken from one text of each class, and the same
comparison is made on these.

Edge cases: null texts and those under MIN_WORDS words have no spans; a document is a doc_id with its text, so that repeated rows are one
document and rows without a doc_id are told apart by their texts; what repeats only within one document is no match; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inodeon.llm.common import cut, fresh_dir, map_arrow, small_enough, text_bytes

MIN_WORDS = 50
GRAM = 8
WINDOW = 20
REACH = MIN_WORDS - WINDOW + 1
SIDE = WINDOW - 1
SEED = 97
#: Up to so many classes with equal first words are compared in one task.
CROWD = 256
#: More crowds than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes by word, remembered within one batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of so many words, by doubling."""
    out, have = None, 0
    power, width = hashes, 1
    while size:
        if size & 1:
            n = len(hashes) - have - width + 1
            if n <= 0:
                return np.zeros(0, dtype=np.uint64)
            out = power[:n] if out is None else _mixed(out[:n] * _BASE + power[have : have + n])
            have += width
        size >>= 1
        if size:
            n = len(power) - width
            if n <= 0:
                return np.zeros(0, dtype=np.uint64)
            power = _mixed(power[:n] * _BASE + power[width : width + n] + np.uint64(width))
            width *= 2
    return out


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Kept positions of a text's word hashes, in order: the leftmost smallest of every window."""
    grams = _grams(hashes, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << 24) - 1)
    least, width = grams & ~low | np.arange(len(grams), dtype=np.uint64) & low, 1  # of equal hashes the leftmost is least
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    start = np.arange(n, dtype=np.uint64)
    at = (start + (least - start & low)).astype(np.int64)
    kept = at[np.r_[True, at[1:] != at[:-1]]]
    return kept[kept + REACH <= len(hashes)]


def _hashed(text: bytes, words: WordHashes) -> np.ndarray:
    """64-bit hashes of a text's words; none is 0."""
    found = text.split()
    return np.maximum(np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found)), 1)


def _around(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By position: SIDE words behind the first ones, then (backwards) SIDE before them; beyond the text's ends stands 0."""
    padded = np.zeros(len(hashes) + 2 * SIDE, dtype=np.uint64)
    padded[SIDE : SIDE + len(hashes)] = hashes
    views = np.lib.stride_tricks.sliding_window_view(padded, SIDE)
    return np.concatenate([views[at + SIDE + REACH], views[at][:, ::-1]], axis=1)


def suffixes(text: bytes, words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's word hashes, and of its kept suffixes the positions and hashes of the first words."""
    hashes = _hashed(text, words)
    if len(hashes) < MIN_WORDS:
        return hashes, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        at = anchors(hashes)
        return hashes, at, _grams(hashes, REACH)[at]


def _texts(batch: pa.RecordBatch, column: str = "b") -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in batch.column(column)]


def narrow_suffixes(rows: DataFrame) -> DataFrame:
    """``(first, row)`` of all kept suffixes, once for each row and first words: a run of one word has very many of them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = WordHashes()
        parts = [np.unique(suffixes(t, words)[2]) for t in _texts(batch)]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), batch.column(0).take(pa.array(owner))], ["first", "row"])

    return map_arrow(rows.select("row", "b"), run, "first long, row long")


def wide_suffixes(rows: DataFrame) -> DataFrame:
    """``(first, cls, sides, row, doc_id, places)`` of the suffixes whose first words are in ``firsts``; sides: 16 bits of the words behind, then before.

    Equal suffixes of one text are one row with all their places.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = WordHashes()
        parts = []
        for i, (text, firsts) in enumerate(zip(_texts(batch), batch.column(3))):
            hashes, at, first = suffixes(text, words)
            own = np.isin(first, firsts.values.to_numpy().view(np.uint64))
            at, first = at[own], first[own]
            around = _around(hashes, at)
            with np.errstate(over="ignore"):
                cls = first.copy()
                for column in around.T:
                    cls = _mixed(cls * _BASE + column)
            narrow = np.where(around > 0, np.maximum(around & np.uint64(0xFFFF), 1), 0).astype(">u2")
            parts.append((at, first, narrow, np.full(len(at), i), cls))
        at, first, sides, owner, cls = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((at, cls, owner))
        at, first, sides, owner, cls = (x[order] for x in (at, first, sides, owner, cls))
        starts = np.flatnonzero(np.r_[len(at) > 0, (owner[1:] != owner[:-1]) | (cls[1:] != cls[:-1])])
        places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), pa.array(at.astype(np.int32)))
        of = pa.array(owner[starts])
        columns = [pa.array(first[starts].view(np.int64)), pa.array(cls[starts].view(np.int64)), _raw(sides[starts]), batch.column(0).take(of), batch.column(1).take(of), places]
        return pa.RecordBatch.from_arrays(columns, ["first", "cls", "sides", "row", "doc_id", "places"])

    return map_arrow(rows.select("row", "doc_id", "b", "firsts"), run, "first long, cls long, sides binary, row long, doc_id long, places array<int>")


def whole_sides(members: DataFrame) -> DataFrame:
    """``(first, cls, sides, low, place, high)`` with the whole hashes of the words around, from ``(b, members)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = WordHashes()
        found = batch.column(1).flatten()
        place = found.field("place").to_numpy()
        at = np.r_[0, np.cumsum(batch.column(1).value_lengths().to_numpy())]
        sides = [_around(_hashed(t, words), place[a:z]) for t, a, z in zip(_texts(batch), at, at[1:])]
        raw = _raw(np.concatenate(sides).astype(">u8"))
        return pa.RecordBatch.from_arrays([found.field("first"), found.field("cls"), raw, found.field("low"), found.field("place"), found.field("high")], ["first", "cls", "sides", "low", "place", "high"])

    return map_arrow(members.select("b", "members"), run, "first long, cls long, sides binary, low long, place int, high long")


def _raw(sides: np.ndarray) -> pa.Array:
    width = sides.shape[1] * sides.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(sides), [None, pa.py_buffer(np.ascontiguousarray(sides).tobytes())]).cast(pa.binary())


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b"))
    return rows.select(F.xxhash64("doc_id", "b").alias("row"), "doc_id", "b")


def window_keys(first: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """By class and a = 0..SIDE: a hash of the MIN_WORDS words from a words before the suffix on; 0 where they leave the text."""
    words = sides.astype(np.uint64)
    ahead = np.zeros((len(first), SIDE + 1), dtype=np.uint64)
    back = np.zeros((len(first), SIDE + 1), dtype=np.uint64)
    inside_ahead = np.ones((len(first), SIDE + 1), dtype=bool)
    inside_back = np.ones((len(first), SIDE + 1), dtype=bool)
    with np.errstate(over="ignore"):
        for i in range(SIDE):
            ahead[:, i + 1] = _mixed(ahead[:, i] * _BASE + words[:, i])
            back[:, i + 1] = _mixed(back[:, i] * _BASE + words[:, SIDE + i])
            inside_ahead[:, i + 1] = inside_ahead[:, i] & (words[:, i] > 0)
            inside_back[:, i + 1] = inside_back[:, i] & (words[:, SIDE + i] > 0)
        keys = _mixed(_mixed(first[:, None] * _BASE + ahead[:, ::-1]) * _BASE + back + np.arange(SIDE + 1, dtype=np.uint64))
    return np.where(inside_ahead[:, ::-1] & inside_back, np.maximum(keys, 1), 0)


def _sides(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=f">u{width}").reshape(-1, 2 * SIDE)


def _matches(first: np.ndarray, cls: np.ndarray, sides: np.ndarray, low: np.ndarray, place: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """``(first, cls, low, place, high, before, behind)`` of the classes that match, for sorted classes of whole groups of equal first words.

    Neighbours are compared word by word on what follows. A run of neighbours that have SIDE - a words in common there is
    extended left: its classes that also have a words in common before match, if they are in two documents.
    """
    n = len(first)
    behind_words, before_words = sides[:, :SIDE], sides[:, SIDE:].astype(np.uint64)
    agree = np.concatenate([behind_words[1:] == behind_words[:-1], np.zeros((n - 1, 1), dtype=bool)], axis=1).argmin(axis=1)
    common = np.where(first[1:] == first[:-1], agree, -1)  # words that a class has in common with the one above
    room_behind, room_before = ((np.c_[w > 0, np.zeros(n, dtype=bool)]).argmin(axis=1) for w in (behind_words, before_words))
    before, behind = np.full(n, -1), np.full(n, -1)
    left = np.zeros(n, dtype=np.uint64)  # a hash of the a words before
    for a in range(SIDE + 1):
        run = np.r_[0, np.cumsum(common < SIDE - a)]
        order = np.lexsort((left, run))
        starts = np.flatnonzero(np.r_[True, (run[order][1:] != run[order][:-1]) | (left[order][1:] != left[order][:-1])])
        across = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
        hit = order[np.repeat(across, np.diff(np.r_[starts, n]))]
        hit = hit[(room_behind[hit] >= SIDE - a) & (room_before[hit] >= a)]
        before[hit] = a
        behind[hit] = np.maximum(behind[hit], SIDE - a)
        if a < SIDE:
            with np.errstate(over="ignore"):
                left = _mixed(left * _BASE + before_words[:, a])
    hit = before >= 0
    columns = [first[hit].view(np.int64), cls[hit], low[hit], place[hit], high[hit], before[hit].astype(np.int32), behind[hit].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["first", "cls", "low", "place", "high", "before", "behind"])


_CLASS = ("first", "cls", "sides", "low", "place", "high")
_MATCH = "first long, cls long, low long, place int, high long, before int, behind int"


def compare_neighbours(classes: DataFrame, width: int) -> DataFrame:
    """Matches among classes, dealt out by their first words and sorted; no group has more than CROWD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() if c != "sides" else _sides(batch.column(c), width) for c in _CLASS]
            now[0] = now[0].view(np.uint64)
            rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            whole = int(np.searchsorted(rest[0].view(np.int64), rest[0].view(np.int64)[-1], "left"))
            if whole:
                yield _matches(*(x[:whole] for x in rest))
                rest = [x[whole:] for x in rest]
        if rest:
            yield _matches(*rest)

    return classes.select(*_CLASS).repartition("first").sortWithinPartitions("first", "sides").mapInArrow(run, _MATCH)


def compare_crowds(classes: DataFrame, width: int) -> DataFrame:
    """The same for classes of any number with equal first words, by counting the keys of their windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = window_keys(batch.column(0).to_numpy().view(np.uint64), _sides(batch.column(2), width))
        row, a = np.nonzero(keys)
        take = pa.array(row)
        own = [batch.column(c).take(take) for c in ("first", "cls", "low", "place", "high")]
        return pa.RecordBatch.from_arrays([pa.array(keys[row, a].view(np.int64)), pa.array(a.astype(np.int32)), *own], ["key", "a", "first", "cls", "low", "place", "high"])

    keyed = map_arrow(classes.select(*_CLASS), run, "key long, a int, first long, cls long, low long, place int, high long", 4096)
    shared = keyed.groupBy("key").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo <> hi").select("key")
    found = keyed.join(shared, "key").groupBy("first", "cls").agg(F.first("low").alias("low"), F.first("place").alias("place"), F.first("high").alias("high"), F.max("a").alias("before"), (F.lit(SIDE) - F.min("a")).cast("int").alias("behind"))
    return found


def compare(classes: DataFrame, width: int = 2) -> DataFrame:
    """The matches among ``(first, cls, sides, low, place, high)``; words have so many bytes."""
    crowds = cut(classes.groupBy("first").count().where(F.col("count") > CROWD).select("first"))
    side = F.broadcast(crowds) if small_enough(crowds, MAX_BROADCAST) else crowds
    return cut(compare_neighbours(classes.join(side, "first", "left_anti"), width).unionByName(compare_crowds(classes.join(side, "first", "left_semi"), width)))


def settled(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The matches of the first comparison that hold for the words' whole hashes.

    A class in two documents has all its words in common with itself. Others are compared once more, with all that match and share their first words.
    """
    alone = F.col("low") == F.col("high")
    again = found.join(found.where(alone).select("first").distinct(), "first", "left_semi")
    members = again.groupBy("low").agg(F.collect_list(F.struct("first", "cls", "low", "place", "high")).alias("members")).withColumnRenamed("low", "row")
    members = cut(members)
    keys = members.select("row")
    texts = rows.join(F.broadcast(keys) if small_enough(keys, MAX_BROADCAST) else keys, "row", "left_semi").dropDuplicates(["row"])
    exact = fresh_dir(rows.sparkSession, "suffix-members")
    whole_sides(texts.join(members, "row")).write.parquet(exact)
    return found.where(~alone).unionByName(compare(rows.sparkSession.read.parquet(exact), 8).where(alone)).select("cls", "before", "behind")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words)``: maximal spans of words that are covered by matches, end exclusive."""
    spark = docs.sparkSession
    rows = _rows(docs)
    kept = fresh_dir(spark, "suffix-firsts")
    narrow_suffixes(rows).write.parquet(kept)  # used twice, and finding the positions is most of the work
    narrow = spark.read.parquet(kept)
    shared = narrow.groupBy("first").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select("first")
    firsts = narrow.join(cut(shared), "first").groupBy("row").agg(F.collect_set("first").alias("firsts"))
    stored = fresh_dir(spark, "suffixes")
    wide_suffixes(rows.join(firsts, "row")).write.parquet(stored)
    wide = spark.read.parquet(stored)
    one = F.min(F.struct("row", F.element_at("places", 1).alias("place"))).alias("one")
    classes = wide.groupBy("first", "cls").agg(F.first("sides").alias("sides"), one, F.max("row").alias("high"))
    kinds = fresh_dir(spark, "suffix-classes")
    classes.select("first", "cls", "sides", F.col("one.row").alias("low"), F.col("one.place").alias("place"), "high").write.parquet(kinds)
    found = settled(compare(spark.read.parquet(kinds)), rows)
    hits = wide.select("cls", "row", "doc_id", "places").join(cut(found), "cls").withColumn("pos", F.explode("places"))
    spans = hits.select("row", "doc_id", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + REACH + F.col("behind")).alias("end")).distinct()
    by = Window.partitionBy("row", "doc_id").orderBy("start", "end")
    spans = spans.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("span", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("row", "doc_id", "span").agg(F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def _oracle_sql() -> str:
    """All windows of MIN_WORDS words by doubling, those in two documents, and the union of each document's."""
    steps, have = ["k1 AS (SELECT doc_id, pos, n, hash(word) AS h FROM words)"], 1
    lead = "lead(h, {}) OVER (PARTITION BY doc_id ORDER BY pos)"
    while have < MIN_WORDS:
        step = min(have, MIN_WORDS - have)
        steps.append(f"k{have + step} AS (SELECT doc_id, pos, n, hash(h, {lead.format(step)}) AS h FROM k{have})")
        have += step
    return f"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n FROM texts WHERE len(w) >= {MIN_WORDS}
), {', '.join(steps)}, shared AS (
  SELECT h FROM k{MIN_WORDS} WHERE pos + {MIN_WORDS} <= n GROUP BY h HAVING min(doc_id) <> max(doc_id)
), hits AS (
  SELECT doc_id, pos, pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {MIN_WORDS} AS fresh
  FROM k{MIN_WORDS} JOIN shared USING (h) WHERE pos + {MIN_WORDS} <= n
), spans AS (
  SELECT doc_id, pos, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM hits
)
SELECT doc_id, min(pos)::BIGINT AS start_word, (max(pos) + {MIN_WORDS})::BIGINT AS end_word, (max(pos) + {MIN_WORDS} - min(pos))::BIGINT AS n_words
FROM spans GROUP BY doc_id, span
"""


ORACLE_SQL = _oracle_sql()
