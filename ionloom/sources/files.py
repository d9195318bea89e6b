"""Files by path or URI (anything pyarrow's file systems reach), for readers that run in tasks."""

from __future__ import annotations

import fnmatch
from typing import BinaryIO

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder that end so, or of those that fit a pattern in the last part; sorted by path."""
    system, inner = _at(path)
    head = path[: len(path) - len(inner)] if "://" in path and path.endswith(inner) else ""
    folder, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)) if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.endswith(suffix)]
        else:
            found = [info] if info.is_file else []
    return sorted((head + f.path, f.size) for f in found)


def opened(path: str) -> BinaryIO:
    """The file for reading from any place in it."""
    system, inner = _at(path)
    return system.open_input_file(inner)
