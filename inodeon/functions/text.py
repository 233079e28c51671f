"""Scalar column expressions on names, volume paths and drive specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\\"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_ascii(c: Column | str) -> Column:
    """Case folding of A-Z only, as name matches use."""
    return F.translate(_col(c), UPPER, LOWER)


def utf16_units(c: Column | str) -> Column:
    """Length in UTF-16 units."""
    return F.floor(F.octet_length(F.encode(_col(c), "UTF-16LE")) / 2).cast("int")


def volume_path(c: Column | str) -> Column:
    """Normalised device path: a volume GUID path loses its last separator, ``X``, ``X:`` and ``X:\\`` become ``\\\\.\\X:``, a
    device path stays; anything else, null and empty included, raises."""
    c = _col(c)
    guid = F.startswith(c, F.lit("\\\\?\\Volume{"))
    stripped = F.when(F.endswith(c, F.lit(SEPARATOR)), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    letter = c.rlike(r"^[A-Za-z](:\\?)?$")
    device = F.startswith(c, F.lit("\\\\.\\"))
    known = F.when(guid, stripped).when(device, c).when(letter, F.concat(F.lit("\\\\.\\"), F.substring(c, 1, 1), F.lit(":")))
    bad = F.raise_error(F.concat(F.lit("not a volume path: "), F.coalesce(c, F.lit("null"))))
    return F.when(known.isNotNull(), known).otherwise(bad)


def drive_letter(c: Column | str) -> Column:
    """The letter of a device path ``\\\\.\\X:`` of six characters, else an empty string."""
    return F.regexp_extract(_col(c), r"^\\\\\.\\([A-Za-z]):$", 1)


def normal_drive(c: Column | str) -> Column:
    """A drive key: without trailing colons and separators, in upper case."""
    return F.upper(F.regexp_replace(_col(c), r"[:\\/]+$", ""))


def drive_specs(c: Column | str) -> Column:
    """``array<struct<letter, journal_id, next_usn, map_name, profile>>`` of ``letter:journalId:nextUsn[:map[:profile]]``, comma-joined.

    Blank entries are skipped, the profile defaults to 0, any other than 0 and 1 raises.
    """
    tokens = F.filter(F.split(_col(c), ","), lambda t: F.trim(t) != "")

    def parsed(t: Column) -> Column:
        part = F.split(t, ":")
        profile = F.coalesce(F.get(part, F.lit(4)).cast("int"), F.lit(0))
        checked = F.when(profile.isin(0, 1), profile).otherwise(F.raise_error(F.concat(F.lit("unknown profile in "), t)).cast("int"))
        return F.struct(
            F.get(part, F.lit(0)).alias("letter"),
            F.get(part, F.lit(1)).cast("decimal(20,0)").alias("journal_id"),
            F.get(part, F.lit(2)).cast("long").alias("next_usn"),
            F.get(part, F.lit(3)).alias("map_name"),
            checked.alias("profile"),
        )

    return F.transform(tokens, parsed)


def drive_spec_text(letter: Column, journal_id: Column, next_usn: Column, map_name: Column, profile: Column) -> Column:
    """The specification of one drive."""
    return F.concat_ws(":", letter, journal_id.cast("string"), next_usn.cast("string"), map_name, profile.cast("string"))


def quoted_arguments(c: Column | str) -> Column:
    """An argument list as one string, each in double quotes."""
    return F.array_join(F.transform(_col(c), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " ")
