"""Files that tasks write to the shared folder themselves.

A file is written under a name of its own for each attempt and then moved to its
final name, so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@contextlib.contextmanager
def published(path: str) -> Iterator:
    """An output stream whose file appears under ``path`` only when complete."""
    fs, name = opened(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    task = TaskContext.get()
    own = f"{name}.part-{task.taskAttemptId() if task else 0}"
    try:
        with fs.open_output_stream(own) as out:
            yield out
        fs.move(own, name)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(own)
        raise


def read_bytes(path: str) -> bytes:
    fs, name = opened(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def partition() -> int:
    task = TaskContext.get()
    return task.partitionId() if task else 0
