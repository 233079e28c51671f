"""Record predicates, name searches and inventory projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inodeon.functions.text import fold_ascii
from inodeon.model import MatchFlags, ScanProfile
from inodeon.operators.paths import resolve_paths

#: Longer keep lists are joined as a table of names, which Spark broadcasts if its size allows.
MAX_INLINE = 64


def name_predicate(name: Column, text: str | None, flags: MatchFlags = MatchFlags.EXACT, folded: bool = False) -> Column:
    """True for names that match ``text``; exact wins over contains; a text without either bit matches nothing, no text everything.

    ``folded`` says that the column is case-folded already, so that a source can take the predicate.
    """
    if text is None:
        return F.lit(True)
    value = name if folded else fold_ascii(name)
    needle = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    if flags & MatchFlags.EXACT:
        return value == F.lit(needle)
    if flags & MatchFlags.CONTAINS:
        return value.contains(needle)
    return F.lit(False)


def live_records(records: DataFrame) -> DataFrame:
    """Base records in use with a name, from rows with magic_ok, flags, base_reference and file_name."""
    return records.where(F.col("magic_ok") & (F.col("flags").bitwiseAND(1) != 0) & (F.col("base_reference") == 0) & F.col("file_name").isNotNull())


def find_by_name(records: DataFrame, text: str | None, flags: MatchFlags = MatchFlags.EXACT, drive: str = "") -> DataFrame:
    """Records whose name matches, with ``full_path`` if asked for; the hierarchy is looked up in all records."""
    folded = "name_fold" in records.columns
    found = records.where(name_predicate(F.col("name_fold" if folded else "file_name"), text, flags, folded))
    if flags & MatchFlags.RESOLVE_PATHS:
        found = resolve_paths(found, records, drive=drive)
    return found


def find_records(records: DataFrame, name: str, directory: bool | None = None, drive: str = "") -> DataFrame:
    """``(record_number, path)`` of exact matches: directories, files or both."""
    found = find_by_name(records, name, MatchFlags.EXACT | MatchFlags.RESOLVE_PATHS, drive)
    if directory is not None:
        found = found.where((F.col("flags").bitwiseAND(2) != 0) == F.lit(directory))
    return found.select("record_number", F.coalesce("full_path", "file_name").alias("path"))


def find_directories(records: DataFrame, name: str, drive: str = "") -> DataFrame:
    return find_records(records, name, True, drive)


def find_files(records: DataFrame, name: str, drive: str = "") -> DataFrame:
    return find_records(records, name, False, drive)


def first_names(records: DataFrame, n: int = 25) -> DataFrame:
    """The first names in record order; empty ones are skipped."""
    return records.where(F.length("file_name") > 0).orderBy("record_number").limit(n).select("record_number", "file_name")


def keep_profile(records: DataFrame, profile: ScanProfile, keep: Iterable[str] = (), name: str = "file_name", directory: str = "is_directory") -> DataFrame:
    """All records, or directories and the named files (whatever their case); the full profile ignores the names."""
    if profile == ScanProfile.FULL:
        return records
    if profile != ScanProfile.DIRECTORY_INDEX:
        raise ValueError(f"unknown scan profile {profile!r}")
    names = sorted({k.upper() for k in keep})
    if len(names) <= MAX_INLINE:
        return records.where(F.col(directory) | F.upper(name).isin(names)) if names else records.where(directory)
    table = records.sparkSession.createDataFrame([(k,) for k in names], "_keep string")
    marked = records.join(table.withColumn("_kept", F.lit(True)), F.upper(name) == F.col("_keep"), "left")
    return marked.where(F.col(directory) | F.col("_kept").isNotNull()).drop("_keep", "_kept")


def inventory(records: DataFrame, path: str = "full_path") -> DataFrame:
    """The scan inventory: records in use with a path; sizes and times are not read and stay 0."""
    return records.where((F.col("flags").bitwiseAND(1) != 0) & F.col(path).isNotNull() & (F.col(path) != "")).select(
        "record_number",
        "parent_record_number",
        F.lit(0).cast("decimal(20,0)").alias("size"),
        F.lit(0).cast("long").alias("last_write_ticks"),
        F.col("file_attributes").alias("attributes"),
        (F.col("flags").bitwiseAND(2) != 0).alias("is_directory"),
        F.col("file_name").alias("name"),
        F.col(path).alias("path"),
    )


def repeated_numbers(records: DataFrame, *keys: str) -> DataFrame:
    """Record numbers that occur more than once: what a unique index would refuse."""
    keys = keys or ("record_number",)
    return records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
