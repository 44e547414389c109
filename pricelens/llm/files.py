"""Binary files in the shared folder, written and read by tasks.

A file gets a name of its own for every attempt of a task and counts only once
the table that lists it is complete, so retried or lost tasks leave at most an
unlisted file behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def normal(uri: str) -> str:
    """``file:/x`` as ``file:///x``."""
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Writer:
    """A new file ``<folder>/<stem>-<unique><suffix>``; ``uri`` names it."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{normal(folder).rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.fs, path = open_fs(self.uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends and returns where the data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


def stream(uri: str):
    fs, path = open_fs(normal(uri))
    return fs.open_input_stream(path, compression=None)


def random_access(uri: str):
    fs, path = open_fs(normal(uri))
    return fs.open_input_file(path)


def read_all(uri: str) -> bytes:
    with stream(uri) as f:
        return f.read()
