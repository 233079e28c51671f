"""Schemas, flag enumerations and errors of the filesystem-metadata tables."""

from __future__ import annotations

from enum import Enum, IntEnum, IntFlag

ROOT = 5
REFERENCE_MASK = 0x0000FFFFFFFFFFFF
RECORD_SIZE = 1024
#: Caps of a resolved path: components, and UTF-16 units with the end mark.
MAX_DEPTH = 128
MAX_UNITS = 1024

MFT_RECORDS = (
    "drive string, record_number long, parent_record_number long, flags int, in_use boolean, is_directory boolean, "
    "file_attributes long, file_name string, name_fold string, fixup_ok boolean"
)
USN_ENTRIES = (
    "drive string, journal_id decimal(20,0), record_number long, parent_record_number long, usn long, filetime long, "
    "reason long, file_attributes long, file_name string"
)
CURSORS = "drive string, journal_id decimal(20,0), next_usn long"
SCAN_RECORDS = (
    "record_number long, parent_record_number long, size decimal(20,0), last_write_ticks long, attributes long, "
    "is_directory boolean, name string, path string"
)


class MatchFlags(IntFlag):
    NONE = 0
    EXACT = 1
    CONTAINS = 2
    RESOLVE_PATHS = 4


class ScanProfile(IntEnum):
    FULL = 0
    DIRECTORY_INDEX = 1


class SessionState(Enum):
    PARKED = "parked"
    WATCHING = "watching"
    FAULTED = "faulted"
    DISPOSED = "disposed"


# Fixed values of the on-disk format: bits of a change record's reason.
REASONS: dict[str, int] = {
    "DataOverwrite": 0x00000001,
    "DataExtend": 0x00000002,
    "DataTruncation": 0x00000004,
    "NamedDataOverwrite": 0x00000010,
    "NamedDataExtend": 0x00000020,
    "NamedDataTruncation": 0x00000040,
    "FileCreate": 0x00000100,
    "FileDelete": 0x00000200,
    "EaChange": 0x00000400,
    "SecurityChange": 0x00000800,
    "RenameOldName": 0x00001000,
    "RenameNewName": 0x00002000,
    "IndexableChange": 0x00004000,
    "BasicInfoChange": 0x00008000,
    "HardLinkChange": 0x00010000,
    "CompressionChange": 0x00020000,
    "EncryptionChange": 0x00040000,
    "ObjectIdChange": 0x00080000,
    "ReparsePointChange": 0x00100000,
    "StreamChange": 0x00200000,
    "TransactedChange": 0x00400000,
    "IntegrityChange": 0x00800000,
    "Close": 0x80000000,
}
# Fixed values of the on-disk format: bits of a file's attributes.
ATTRIBUTES: dict[str, int] = {"ReadOnly": 0x01, "Hidden": 0x02, "System": 0x04, "Directory": 0x10, "Archive": 0x20}


class JournalError(RuntimeError):
    """A change journal can't be read."""


class JournalNotActive(JournalError):
    pass


class JournalDeleting(JournalError):
    pass


class JournalWrapped(JournalError):
    """Entries after the cursor are gone: a full rescan is needed."""
