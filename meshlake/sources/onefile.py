"""One file from many tasks: each byte's place is known before it is written.

Tasks write to a temporary file beside the wanted one, each at its own places; when all are
through, the file takes its name in one step.  A task that runs again, or twice at once,
writes the same bytes to the same places, so nothing is decided by which attempt came
first.  That needs a folder which driver and executors share and in which files can be
written at any place: a local one, or a mounted one.  Stores that only append have no such
files; there tables are written in parts, which ``tables.read_tables`` takes as one.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str:
    """The path of a ``file`` URI, or of none; other schemes are an error."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{parts.scheme} has no files that are written at any place: write parts instead")
    return unquote(parts.path) if parts.scheme else uri


def begun(uri: str, size: int) -> str:
    """A temporary file of that size beside ``uri``; it reads as zeros."""
    path = local_path(uri)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(made, "wb") as f:
        f.truncate(size)
    return made


class Places:
    """Writes at places of a file that ``begun`` made."""

    def __init__(self, path: str):
        self.file = os.open(path, os.O_WRONLY)

    def put(self, at: int, data: bytes | memoryview) -> None:
        view = memoryview(data).cast("B")
        while len(view):
            n = os.pwrite(self.file, view, at)
            at, view = at + n, view[n:]

    def __enter__(self) -> "Places":
        return self

    def __exit__(self, *_: object) -> None:
        os.fsync(self.file)
        os.close(self.file)


def finished(made: str, uri: str) -> None:
    os.replace(made, local_path(uri))


def dropped(made: str) -> None:
    if os.path.exists(made):
        os.unlink(made)
