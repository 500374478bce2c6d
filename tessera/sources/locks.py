"""Lock files in a shared folder.

A lock is a file that only one writer can create. It holds the owner's token; who
finds one that is older than ``stale`` takes it over, and only the owner removes it.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Seconds after which a synchronisation lock and a catalog lock are stale, and the
#: catalog's tries and the wait between them (fixed values).
SYNC_STALE, CATALOG_STALE, CATALOG_TRIES, CATALOG_WAIT = 600.0, 10.0, 5, 0.1


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Lock:
    """``with Lock(...)`` raises ``TimeoutError`` where the lock can't be had."""

    def __init__(self, spark: SparkSession, path: str, stale: float = SYNC_STALE, tries: int = 1, wait: float = CATALOG_WAIT):
        self.spark, self.path, self.stale, self.tries, self.wait = spark, path, stale, tries, wait
        self.token = uuid.uuid4().hex

    def held_by(self) -> str | None:
        """The token in the file, or None without one."""
        p, fs = hadoop_path(self.spark, self.path)
        try:
            source = fs.open(p)
        except Py4JJavaError:
            return None
        try:
            return bytes(source.readNBytes(64)).decode()
        finally:
            source.close()

    def acquire(self) -> bool:
        p, fs = hadoop_path(self.spark, self.path)
        for k in range(self.tries):
            if k:
                time.sleep(self.wait)
            try:
                if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.stale:
                    fs.delete(p, False)
                out = fs.create(p, False)
            except Py4JJavaError:
                continue
            out.write(bytearray(self.token.encode()))
            out.close()
            if self.held_by() == self.token:
                return True
        return False

    def release(self) -> None:
        if self.held_by() == self.token:
            p, fs = hadoop_path(self.spark, self.path)
            fs.delete(p, False)

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise TimeoutError(f"{self.path} is held by another writer")
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def catalog_lock(spark: SparkSession, path: str) -> Lock:
    return Lock(spark, path, CATALOG_STALE, CATALOG_TRIES)
