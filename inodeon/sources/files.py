"""Ranged reads and listings for the data sources, on local paths and on URIs that Arrow's file systems know."""

from __future__ import annotations

from typing import BinaryIO

import pyarrow.fs as pafs


def _split(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def size(path: str) -> int:
    fs, p = _split(path)
    info = fs.get_file_info(p)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def is_folder(path: str) -> bool:
    fs, p = _split(path)
    return fs.get_file_info(p).type == pafs.FileType.Directory


def read_range(path: str, offset: int, length: int) -> bytes:
    fs, p = _split(path)
    with fs.open_input_file(p) as f:
        return f.read_at(length, offset)


def create(path: str) -> BinaryIO:
    fs, p = _split(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(p)


def names(folder: str, suffix: str) -> list[str]:
    """Names of the files with a suffix, sorted; none if the folder is missing."""
    fs, p = _split(folder)
    found = fs.get_file_info(pafs.FileSelector(p, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.File and i.base_name.endswith(suffix))


def sizes(folder: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the files with a suffix, sorted; none if the folder is missing."""
    fs, p = _split(folder)
    found = fs.get_file_info(pafs.FileSelector(p, allow_not_found=True))
    return sorted((i.base_name, i.size) for i in found if i.type == pafs.FileType.File and i.base_name.endswith(suffix))


def exists(path: str) -> bool:
    fs, p = _split(path)
    return fs.get_file_info(p).type == pafs.FileType.File


def rename(old: str, new: str) -> None:
    fs, a = _split(old)
    fs.move(a, _split(new)[1])


def delete(path: str) -> None:
    fs, p = _split(path)
    if fs.get_file_info(p).type == pafs.FileType.File:
        fs.delete_file(p)
