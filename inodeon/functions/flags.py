"""Scalar column expressions on flag words and file times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inodeon.model import ATTRIBUTES, REASONS, REFERENCE_MASK

EPOCH_1601 = 116444736000000000
_RENAME = REASONS["RenameOldName"] | REASONS["RenameNewName"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(c: Column | str, mask: int) -> Column:
    return _col(c).cast("long").bitwiseAND(F.lit(mask).cast("long")) != 0


def in_use(flags: Column | str) -> Column:
    return has(flags, 1)


def is_directory(flags: Column | str) -> Column:
    return has(flags, 2)


def is_create(reason: Column | str) -> Column:
    return has(reason, REASONS["FileCreate"])


def is_delete(reason: Column | str) -> Column:
    return has(reason, REASONS["FileDelete"])


def is_rename(reason: Column | str) -> Column:
    return has(reason, _RENAME)


def is_close(reason: Column | str) -> Column:
    return has(reason, REASONS["Close"])


def record_of(reference: Column | str) -> Column:
    """The record number of a file reference: its low 48 bits."""
    return _col(reference).bitwiseAND(F.lit(REFERENCE_MASK))


def names_of(c: Column | str, names: dict[str, int]) -> Column:
    """``array<string>`` of the names whose bits are set, lowest bit first."""
    return F.filter(F.array(*(F.when(has(c, bit), F.lit(name)) for name, bit in names.items())), lambda x: x.isNotNull())


def attribute_names(c: Column | str) -> Column:
    return names_of(c, ATTRIBUTES)


def reason_text(c: Column | str) -> Column:
    """Names joined by comma and space; ``None`` for 0; the plain number if a bit has no name."""
    c = _col(c).cast("long")
    known = sum(REASONS.values())
    return F.when(c == 0, F.lit("None")).when(c.bitwiseAND(F.lit(~known)) != 0, c.cast("string")).otherwise(F.array_join(names_of(c, REASONS), ", "))


def entry_text(reason: Column | str, name: Column | str, record: Column | str) -> Column:
    return F.concat(F.lit("["), reason_text(reason), F.lit("] "), _col(name), F.lit(" (record "), _col(record).cast("string"), F.lit(")"))


def filetime_to_timestamp(c: Column | str) -> Column:
    """UTC time of 100 ns ticks since 1601, to the microsecond; 0001-01-01 for 0 and less."""
    ticks = F.when(_col(c) > 0, _col(c) - F.lit(EPOCH_1601)).otherwise(F.lit(0))
    return F.when(_col(c) <= 0, F.lit("0001-01-01 00:00:00").cast("timestamp")).otherwise(F.timestamp_micros(F.call_function("div", ticks - F.pmod(ticks, F.lit(10)), F.lit(10).cast("long"))))


def timestamp_to_filetime(c: Column | str) -> Column:
    return F.unix_micros(_col(c)) * 10 + F.lit(EPOCH_1601)
