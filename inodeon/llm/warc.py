"""WARC archives: writing with revisit records, reading by boundary-chain verification (operator 6).

Writing: one record for each page. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page_id is the response,
the others revisit it. Records go through Spark's text writer, one archive a partition, at most ``MAX_RECORDS`` records each.

Reading: archives are split at every magic, also inside payloads and by many tasks an archive. Each piece that parses as a record header is a
candidate and points from its offset to that of its successor. Candidates whose successor is the next candidate form runs;
pointer jumping over the runs, from the start of each file, retains the records on the chain and no others, in a
logarithmic number of rounds of joins on offsets. Payloads are hashed where they are read; only those that contain a magic
themselves are put together from their pieces in a second pass.

Edge cases: null payloads and URLs count as empty; line ends in header values are escaped; repeated rows get a record each, and all rows of the
largest page_id are responses; a null page_id is smaller than all others; no pages give no records. A chain that breaks ends its file's records there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inodeon.llm.common import cut, fresh_dir, small_enough

MAGIC = b"WARC/1."
MIN_REVISIT = 1000
MAX_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: More groups of equal payloads than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST = 100_000
_LENGTH = re.compile(rb"\d{1,18}")
_FIELDS = {b"warc-type": 0, b"warc-record-id": 1, b"warc-refers-to": 2, b"warc-payload-digest": 3, b"payload-length": 4, b"warc-target-uri": 5}
_PIECE = "file string, block long, rel long, size long, first boolean, head long, length long, kind string, record_id string, refers_to string, digest string, full_length string, uri string, sha1 string, body binary"


def with_revisits(pages: DataFrame) -> DataFrame:
    """The pages with payload (binary), sha1 and response_id, the page_id of the response that a page revisits, else null."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("n") >= MIN_REVISIT).groupBy(F.col("sha1").alias("_d"), F.col("n").alias("_n")).agg(F.max("page_id").alias("top"), F.count("*").alias("c"))
    groups = cut(groups.where("c > 1").drop("c"))
    side = F.broadcast(groups) if small_enough(groups, MAX_BROADCAST) else groups
    joined = rows.join(side, (F.col("sha1") == F.col("_d")) & (F.col("n") == F.col("_n")), "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", "sha1", "n", F.when(other, F.col("top")).alias("response_id"))


def _safe(value: Column) -> Column:
    """Header values without line ends and without the magic."""
    value = F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("WARC/"), F.lit("WARC%2F"))
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """``(record)``: the bytes of each page's record as a string, but for the last line end."""
    rows = with_revisits(pages)
    revisit = F.col("response_id").isNotNull()
    content = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("response_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("Payload-Length: "), F.col("n").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
        F.lit("\r\n"),
    ]
    head = F.concat_ws("\r\n", *lines).cast("binary")
    return rows.select(F.concat(head, content, F.lit("\r\n").cast("binary")).cast("string").alias("record"))


def write(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", "\r\n").option("maxRecordsPerFile", MAX_RECORDS).mode("error").text(path)


def _parse(piece: bytes) -> tuple[int, int, list[bytes | None]] | None:
    """Of the bytes behind a magic: length of the header with its magic, content length, and the values of _FIELDS."""
    if piece[1:3] != b"\r\n" or piece[:1] not in b"01":
        return None
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    values: list[bytes | None] = [None] * len(_FIELDS)
    length = None
    for line in piece[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        name, value = name.strip().lower(), value.strip()
        if name == b"content-length" and _LENGTH.fullmatch(value):
            length = int(value)
        elif name in _FIELDS:
            values[_FIELDS[name]] = value
    return None if length is None else (len(MAGIC) + end + 4, length, values)


def pieces(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """One row for every stretch between magics; ``off`` is the offset of the magic before it (-1 before the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, block) != here:
                    here, at = (file, block), 0
                first = block == 0 and at == 0
                parsed = None if first else _parse(value)
                row: list[object] = [file, block, at, len(value), first, None, None, *[None] * len(_FIELDS), None, value if bodies else None]
                if parsed:
                    head, length, values = parsed
                    row[5:7] = head, length
                    row[7:13] = [None if v is None else v.decode("utf-8", "replace") for v in values]
                    if len(value) == head - len(MAGIC) + length + 4:
                        start = head - len(MAGIC)
                        row[13] = hashlib.sha1(value[start : start + length]).hexdigest()
                rows.append(row)
                at += len(value) + len(MAGIC)
            columns = list(zip(*rows)) if rows else [()] * 15
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.binary()]
            names = [x.split()[0] for x in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")).mapInArrow(run, _PIECE)


def _placed(found: DataFrame) -> DataFrame:
    """Pieces with ``off``, their offset in the file, and ``file_end``; blocks of a file add up from its start."""
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    sizes = sizes.withColumn("file_end", F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).drop("bytes")
    return found.join(sizes, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC)).drop("base")


def _reached(runs: DataFrame) -> DataFrame:
    """Of runs ``(file, run, next)``, the ones on the chain from run 0 of each file, by pointer jumping."""
    reached = cut(runs.where("run = 0").select("file", "run"))
    jumps = cut(runs.where("next is not null").select("file", "run", F.col("next").alias("to")))
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = cut(reached.unionByName(ahead).distinct())
        second = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("further"))
        jumps = cut(jumps.join(second, ["file", "to"]).select("file", "run", F.col("further").alias("to")))
    return reached


def verify(candidates: DataFrame) -> DataFrame:
    """The candidates ``(file, off, succ, ...)`` on the chain of successors from offset 0 of their file."""
    order = Window.partitionBy("file").orderBy("off")
    rows = candidates.withColumn("linked", F.coalesce(F.lag("succ").over(order) == F.col("off"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(order) - 1)
    rows = cut(rows.drop("linked"))
    runs = rows.groupBy("file", "run").agg(F.max("succ").alias("exit"), F.min("off").alias("start"))
    runs = runs.where("run > 0 or start = 0")  # a file that doesn't begin with a record has none
    entries = rows.select("file", F.col("off").alias("exit"), F.col("run").alias("next"))
    runs = cut(runs.join(entries, ["file", "exit"], "left"))
    reached = _reached(runs)
    exits = runs.join(reached, ["file", "run"], "left_semi").where("next is not null")
    entered = exits.select("file", F.col("next").alias("run"), F.col("exit").alias("entry"))
    entered = reached.join(entered, ["file", "run"], "left").select("file", "run", F.coalesce("entry", F.lit(0)).alias("entry"))
    return rows.join(entered, ["file", "run"]).where("off >= entry").drop("run", "entry")


def _assembled(spark: SparkSession, path: str, chain: DataFrame) -> DataFrame:
    """``(file, off, payload)`` of chained records whose payload holds a magic, from the pieces up to their successor."""
    open_ended = chain.where("sha1 is null").select("file", "off", "succ", "head", "length")
    spread = _placed(pieces(spark, path, bodies=True).join(open_ended.select("file").distinct(), "file", "left_semi"))
    marks = spread.select("file", "off", "body").join(chain.select("file", "off", F.col("off").alias("owner")), ["file", "off"], "left")
    order = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    keys = marks.select("file", "off", "owner").withColumn("owner", F.last("owner", ignorenulls=True).over(order))
    own = keys.join(open_ended.select("file", F.col("off").alias("owner"), "succ", "head", "length"), ["file", "owner"]).where("off < succ")
    parts = own.join(spread.select("file", "off", "body"), ["file", "off"])
    whole = parts.groupBy("file", F.col("owner").alias("off"), "head", "length").agg(F.array_sort(F.collect_list(F.struct(F.col("off").alias("o"), "body"))).alias("parts"))
    magic = F.lit(MAGIC.decode()).cast("binary")
    joined = F.aggregate(F.col("parts.body"), F.lit("").cast("binary"), lambda acc, b: F.concat(acc, magic, b))
    return whole.select("file", "off", F.substring(joined, F.col("head") + 1, F.col("length")).alias("payload"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(file, off, kind, record_id, refers_to, uri, digest, full_length, length, sha1)`` of the records on the chain.

    ``digest`` and ``full_length`` are what the header says; ``sha1`` is of the content as read.
    """
    index = fresh_dir(spark, "warc-index")
    pieces(spark, path).drop("body").write.parquet(index)  # the splits are fixed from here on
    found = _placed(spark.read.parquet(index))
    candidates = found.where("length is not null").withColumn("succ", F.col("off") + F.col("head") + F.col("length") + 4)
    candidates = candidates.where("succ <= file_end")
    chain = cut(verify(candidates))
    if not chain.where("sha1 is null").isEmpty():
        late = _assembled(spark, path, chain).select("file", "off", F.sha1("payload").alias("late"))
        chain = chain.join(late, ["file", "off"], "left").withColumn("sha1", F.coalesce("sha1", "late"))
    return chain.select("file", "off", "kind", "record_id", "refers_to", "uri", "digest", "full_length", "length", "sha1")


def page_records(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages to archives (in the shared folder unless a path is given), reads them back, one row a record."""
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "warc")
    write(pages, path)
    found = read(spark, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    revisit = F.col("kind") == "revisit"
    return found.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("full_length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> top THEN top END AS refers_to
FROM m
"""
