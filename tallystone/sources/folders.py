"""File systems for data sources: local paths and whatever pyarrow knows by its scheme."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Found:
    """A file below a folder: its path in the file system, and its size."""

    path: str
    size: int


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before a path so that it can be opened again)."""
    local = re.sub("^file:/+", "/", path)
    if "://" in local:
        system, inner = fs.FileSystem.from_uri(local)
        return system, inner, re.match(r"[a-z0-9+.-]+://[^/]*", local)[0]
    return fs.LocalFileSystem(), local, ""


def files_below(path: str, suffixes: tuple[str, ...] | None = None) -> list[Found]:
    """All files below a folder, or the file itself, in order of their paths; hidden ones are left out."""
    system, inner, _ = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    kept = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._][^/]*", f.path[len(inner) :])]
    return sorted((Found(f.path, f.size) for f in kept if suffixes is None or f.path.lower().endswith(suffixes)), key=lambda f: f.path)


def content(path: str) -> bytes:
    system, inner, _ = opened(path)
    with system.open_input_stream(inner) as f:
        return f.read()
