"""Files that tasks open themselves, at any place, on any file system Arrow knows."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    local = re.match(r"(?:file:(?://)?)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path)


def open_input(path: str) -> pa.NativeFile:
    """A seekable file, of which only what is asked for is read."""
    system, name = located(path)
    return system.open_input_file(name)


def write_file(path: str, content: bytes) -> None:
    """Write a whole file; a task that runs again writes the same name again."""
    system, name = located(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(content)


def exists(path: str) -> bool:
    system, name = located(path)
    return system.get_file_info(name).type == fs.FileType.File


def commit_file(path: str, content: bytes) -> None:
    """Write a file that has its name only when it is whole; a file of that name is replaced."""
    system, name = located(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    folder, last = name.rsplit("/", 1)
    # Spark's readers pass over names that begin so.
    draft = f"{folder}/_{uuid.uuid4().hex}-{last}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, name)


def holds_null(path: str, column: str) -> bool:
    """Does a Parquet file have a null in a column."""
    system, name = located(path)
    return pq.read_table(name, columns=[column], filesystem=system).column(0).null_count > 0
