"""Files of our own formats in the shared folder, written and read from tasks.

Folders named by a ``file:`` URI or a plain path are opened directly; other stores go through pyarrow's file systems.
Writers use a hidden name and rename, so that a repeated task replaces its file by an equal one.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def make_folder(spark: SparkSession, folder: str) -> None:
    if (local := _local(folder)) is not None:
        os.makedirs(local, exist_ok=True)
    else:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)


def open_output(path: str):
    if (local := _local(path)) is not None:
        return open(local, "wb")  # noqa: SIM115
    system, rest = fs.FileSystem.from_uri(path)
    return system.open_output_stream(rest)


def open_input(path: str):
    """A file with random access."""
    if (local := _local(path)) is not None:
        return open(local, "rb")  # noqa: SIM115
    system, rest = fs.FileSystem.from_uri(path)
    return system.open_input_file(rest)


def rename(a: str, b: str) -> None:
    if (local := _local(a)) is not None:
        os.replace(local, _local(b))
        return
    system, old = fs.FileSystem.from_uri(a)
    new = fs.FileSystem.from_uri(b)[1]
    if system.get_file_info(new).type != fs.FileType.NotFound:
        system.delete_file(new)
    system.move(old, new)


def local_copy(path: str) -> tuple[str, bool]:
    """A path that can be memory-mapped, and whether it is a private copy (to be unlinked once it is mapped)."""
    if (local := _local(path)) is not None:
        return local, False
    import shutil
    import tempfile

    handle, name = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as out, open_input(path) as src:
        shutil.copyfileobj(src, out, 1 << 20)
    return name, True
