"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
WHITE = " \t\n\x0b\f\r"
#: Rows handed to a Python worker's function at once, so that memory follows the batch, not the partition.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isEmpty() and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else "/tmp/checkpoints"
    if current.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``fn`` over slices of at most ``rows`` rows; it may return any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = "8m") -> Iterator[None]:
    """Within it, what is run hands Python workers batches of few rows and bytes, so that neither side holds many at once."""
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def text_bytes(col: str | F.Column = "text") -> F.Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary")


def text_hash(col: str | F.Column = "text") -> F.Column:
    """A hash that tells texts apart where doc_id doesn't; null counts as empty."""
    return F.xxhash64(text_bytes(col))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows, looking at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def in_order(df: DataFrame, *order: F.Column) -> DataFrame:
    """The rows with ``place``: their number, from 1, in an order over all of them.

    Ranges of the order are sorted by themselves and written once, so that every later use sees the same ranges; only their
    sizes, one row a range, are added up in one place.
    """
    spark = df.sparkSession
    # the low 33 bits of this number count the rows of a partition
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_row": row})
    out = fresh_dir(spark, "ordered")
    ranged.write.parquet(out)
    ranged = spark.read.parquet(out)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = ranged.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_row") + 1)
    return numbered.drop("_range", "_row", "_size", "_start")


def running(rows: DataFrame, key: list[str], at: str, values: dict[str, tuple[Callable[[F.Column], F.Column], Callable[[F.Column, F.Column], F.Column]]]) -> DataFrame:
    """The rows with each named column replaced by its aggregate over the rows of its key up to its own, in the order of ``at``.

    A value is an aggregate function and a function that puts two aggregates together, both null-tolerant. ``at`` is a long of
    its own for each row of a key. A key's rows are worked on in blocks of 4,096 numbers, so a key of any length is spread over many tasks;
    one row a block is then carried on.
    """
    rows = rows.withColumn("_block", F.shiftright(at, 12))
    inside = Window.partitionBy(*key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "_block").agg(*(agg(F.col(c)).alias(c) for c, (agg, _) in values.items()))
    carried = sums.select(*key, "_block", F.lag("_block").over(Window.partitionBy(*key).orderBy("_block")).alias("_last"), *(agg(F.col(c)).over(before).alias(f"_{c}") for c, (agg, _) in values.items()))
    carried = carried.where("_last is not null").drop("_last")
    rows = rows.withColumns({c: agg(F.col(c)).over(inside) for c, (agg, _) in values.items()}).join(carried, [*key, "_block"], "left")
    return rows.withColumns({c: both(F.col(f"_{c}"), F.col(c)) for c, (_, both) in values.items()}).drop("_block", *(f"_{c}" for c in values))
