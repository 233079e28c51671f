"""Counts, medians and rates of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inodeon.functions.text import utf16_units


def totals(records: DataFrame, used: Column) -> DataFrame:
    """All slots, and the rows that are used."""
    return records.agg(F.count("*").alias("total_records"), F.count_if(used).alias("used_records"))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """``sorted[n div 2]`` of a value by key: the larger of the two middle ones.

    Exact, without gathering a key's rows: approximate quantiles only cut its values into ranges, counts say which range
    holds the middle, and only that range is ranked, by counted values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranged = counted.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))))
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "_at": F.expr("sum(_size) OVER (PARTITION BY " + ", ".join(keys) + ") div 2")})
    middle = sizes.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_size")))
    inside = ranged.join(middle, [*keys, "_range"])
    upto = F.col("_before") + F.sum("_n").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_upto", upto)
    return ranked.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*keys, F.col("_v").alias(name))


def positions(rows: DataFrame, number: str, name: str = "position", bits: int = 12) -> DataFrame:
    """The rows with their place in the order of a number without repeats, from 1 on.

    Rows are ranked within ranges of ``2**bits`` numbers, ranges within ranges of ranges; only sums of the latter, one for
    ``4**bits`` numbers, meet in one task.
    """
    ranged = rows.withColumns({"_fine": F.shiftright(number, bits), "_coarse": F.shiftright(number, 2 * bits)})
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_coarse", "_fine").agg(F.count("*").alias("_n"))
    tops = sizes.groupBy("_coarse").agg(F.sum("_n").alias("_n"))
    tops = tops.select("_coarse", before(Window.orderBy("_coarse")).alias("_base"))
    bases = sizes.withColumn("_inner", before(Window.partitionBy("_coarse").orderBy("_fine"))).join(tops, "_coarse")
    bases = bases.select("_fine", (F.col("_base") + F.col("_inner")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_fine").orderBy(number))
    placed = ranged.withColumn("_rank", rank).join(bases, "_fine")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_rank")).cast("long").alias(name))


def throughput(records: Column, millis: Column) -> Column:
    return F.when(millis > 0, records / (millis / 1000.0))


def report(rows: DataFrame, title: str, records: str, millis: str) -> DataFrame:
    """``(line)``: one line of a text report for each row, with its records, its time and its rate."""
    rate = F.coalesce(F.format_string("%d rec/s", throughput(F.col(records), F.col(millis)).cast("long")), F.lit("-"))
    return rows.select(F.concat(F.col(title).cast("string"), F.lit(": "), F.format_string("%d records in %d ms, ", F.col(records).cast("long"), F.col(millis).cast("long")), rate).alias("line"))


def combine_timers(slices: DataFrame, *keys: str) -> DataFrame:
    """Timers of parallel slices: the longest fixup counts, parsing is what is left of the elapsed time, reads add up."""
    return slices.groupBy(*keys).agg(
        F.sum("io_ms").alias("io_ms"), F.max("fixup_ms").alias("fixup_ms"), (F.max("elapsed_ms") - F.max("fixup_ms")).alias("parse_ms")
    )


def run_bytes(runs: DataFrame, clusters: str, cluster_size: int, record_size: int, *keys: str) -> DataFrame:
    """Bytes of all runs, and the number of whole records in them."""
    total = F.sum(F.col(clusters).cast("long") * cluster_size)
    return runs.groupBy(*keys).agg(total.alias("bytes")).withColumn("records", F.expr(f"bytes div {record_size}"))


def payload_size(scan: DataFrame) -> DataFrame:
    """Bytes of the scan payload file of an inventory: header, fixed rows, and names and paths in UTF-16."""
    units = F.coalesce(utf16_units("name"), F.lit(0)) + F.coalesce(utf16_units("path"), F.lit(0))
    return scan.agg((F.lit(28) + F.lit(56) * F.count("*") + F.lit(2) * F.coalesce(F.sum(units), F.lit(0))).cast("long").alias("bytes"))
