"""Bytes of payloads, read by the task that needs them, from any store that Arrow's file systems reach."""

from __future__ import annotations

import re

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file to read at any offset."""
    store, at = store_of(path)
    return store.open_input_file(at)


def read_bytes(path: str) -> bytes:
    """The whole file."""
    with opened(path) as f:
        return f.read()


def read_range(path: str, start: int, size: int) -> bytes:
    """``size`` bytes from ``start`` on, fewer at the end."""
    with opened(path) as f:
        f.seek(start)
        return f.read(size)
