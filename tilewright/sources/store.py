"""Files by byte ranges, in mounted folders and in the stores that Arrow knows by their address."""

from __future__ import annotations

from collections.abc import Callable

Read = Callable[[int, int], bytes]


def store_of(path: str):
    """The file system of a path and the path inside it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opener(path: str) -> Read:
    """A function that reads some bytes of a file from a place on."""
    store, inner = store_of(path)
    source = store.open_input_file(inner)
    return lambda at, n: source.read_at(n, at)
