"""Single files in any file system that Spark reaches."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession


#: Bytes that go to the file system at once.
BUFFER = 1 << 20


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_size(spark: SparkSession, path: str) -> int | None:
    """Bytes of the file; None if there is none."""
    p, fs = _at(spark, path)
    return fs.getFileStatus(p).getLen() if fs.exists(p) else None


def write_file(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Text parts, in UTF-8, one after another in one new file, without a checksum file that others' writes would break."""
    p, fs = _at(spark, path)
    fs.setWriteChecksum(False)
    out = fs.create(p, True)
    fs.setWriteChecksum(True)
    held, size = [], 0
    try:
        for part in parts:
            held.append(part.encode())
            size += len(held[-1])
            if size >= BUFFER:
                out.write(bytearray(b"".join(held)))
                held, size = [], 0
        out.write(bytearray(b"".join(held)))
    finally:
        out.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    p, fs = _at(spark, path)
    if not fs.rename(p, _at(spark, to)[0]):
        raise OSError(f"can't rename {path} to {to}")


def siblings(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern of the file system, the latest changed first."""
    p, fs = _at(spark, pattern)
    found = sorted(((f.getModificationTime(), f.getPath().toString()) for f in fs.globStatus(p) or []), reverse=True)
    return [path for _, path in found]


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def data_dir(default: str, env: Mapping[str, str] = os.environ) -> str:
    """The folder of the stores: DATA_DIR, else the mounted volume's, else ``default``."""
    return env.get("DATA_DIR") or env.get("RAILWAY_VOLUME_MOUNT_PATH") or default


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of several layouts' paths that exists."""
    return next((c for c in candidates if file_size(spark, c) is not None), None)
