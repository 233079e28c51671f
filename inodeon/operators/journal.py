"""Change journals: cursors, bounded reads, folds, and joins with a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inodeon.functions.flags import is_close, is_create, is_delete, is_rename, record_of
from inodeon.functions.text import SEPARATOR


def with_reason_flags(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"is_create": is_create("reason"), "is_delete": is_delete("reason"), "is_rename": is_rename("reason"), "is_close": is_close("reason")})


def read_since(entries: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Entries from the cursor on, the cursor included, up to the end, which is not."""
    found = entries.where(F.col("usn") >= start)
    return found if end is None else found.where(F.col("usn") < end)


#: Fields of an entry with what stands for one that isn't given.
DEFAULTS = {"drive": ("string", ""), "journal_id": ("decimal(20,0)", 0), "record_number": ("long", 0), "parent_record_number": ("long", 0), "usn": ("long", 0), "filetime": ("long", 0), "reason": ("long", 0), "file_attributes": ("long", 0), "file_name": ("string", "")}


def create_entries(rows: DataFrame, **given: Column | str) -> DataFrame:
    """Change entries from decoded values: the columns given by field, and defaults for the others; references lose their sequence bits."""
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"an entry has no {sorted(unknown)}")

    def value(name: str) -> Column:
        kind, default = DEFAULTS[name]
        found = F.coalesce(F.col(given[name]) if isinstance(given[name], str) else given[name], F.lit(default)) if name in given else F.lit(default)
        return (record_of(found) if name.endswith("record_number") else found).cast(kind).alias(name)

    return rows.select(*(value(name) for name in DEFAULTS))


def next_cursor(entries: DataFrame, *keys: str) -> DataFrame:
    """The cursor after the last entry, by key."""
    return entries.groupBy(*keys).agg((F.max("usn") + 1).alias("next_usn"))


def batches_with_cursor(entries: DataFrame, size: int) -> DataFrame:
    """Entries cut at multiples of ``size``: number of entries and the cursor after each batch; empty ones don't show."""
    return entries.groupBy(F.expr(f"usn div {size}").alias("batch")).agg(F.count("*").alias("n_entries"), (F.max("usn") + 1).alias("next_usn"))


def latest_changes(entries: DataFrame, *keys: str) -> DataFrame:
    """The last entry of every record.

    The maximum of a struct combines before the shuffle, so that a record with very many entries is no single task's work.
    """
    keys = keys or ("record_number",)
    rest = [c for c in entries.columns if c not in (*keys, "usn")]
    last = entries.groupBy(*keys).agg(F.max(F.struct("usn", *rest)).alias("last"))
    return last.select(*keys, "last.*").select(*entries.columns)


def apply_changes(scan: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """The scan with every record's last change applied: deleted ones go, new ones come, names and parents follow."""
    keys = keys or ("record_number",)
    last = latest_changes(entries, *keys).select(*keys, F.col("parent_record_number").alias("_parent"), F.col("file_name").alias("_name"), is_delete("reason").alias("_gone"))
    joined = scan.join(last, list(keys), "full").where(~F.coalesce("_gone", F.lit(False)))
    updates = {"parent_record_number": F.coalesce("_parent", "parent_record_number"), "file_name": F.coalesce("_name", "file_name")}
    return joined.withColumns(updates).select(*scan.columns)


def fold_responses(responses: DataFrame) -> DataFrame:
    """Per drive the last response: ``(drive, seq, ...)``."""
    rest = [c for c in responses.columns if c not in ("drive", "seq")]
    last = responses.groupBy("drive").agg(F.max(F.struct("seq", *rest)).alias("last"))
    return last.select("drive", "last.*").select(*responses.columns)


def with_full_path(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries with the path of their parent (``paths``: record_number, full_path) and their own name."""
    side = paths.select(F.col("record_number").alias("parent_record_number"), F.col("full_path").alias("_parent_path"))
    joined = entries.join(side, "parent_record_number", "left")
    return joined.withColumn("full_path", F.concat_ws(SEPARATOR, "_parent_path", "file_name")).drop("_parent_path")


def snapshot_with_catch_up(scan: DataFrame, entries: DataFrame, armed: int, latest: int) -> DataFrame:
    """Each scanned record with its number of entries between the armed cursor and the latest one: no gap, no overlap."""
    between = read_since(entries, armed, latest).groupBy("record_number").agg(F.count("*").alias("n_changes"), F.max("usn").alias("last_usn"))
    return scan.join(between, "record_number", "left").withColumn("n_changes", F.coalesce("n_changes", F.lit(0).cast("long")))


def ordered_distinct(entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values in the order of their first occurrence, by key."""
    first = entries.groupBy(key, value).agg(F.min(order).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_at", value)).cast("long")
    return first.select(key, value, rank.alias("position"))
