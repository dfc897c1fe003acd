"""A store of tables in one JSON file: an object of table names and arrays of records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.sources.files import delete, file_size, move, siblings, write_file

#: Column for what can't be parsed.
BAD = "__unparsed"


def read_snapshot(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The tables of ``schemas``, typed as declared. Fields that a record lacks are null; a table that the file lacks is empty."""
    whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()])
    doc = spark.read.schema(whole).json(path, multiLine=True, mode="FAILFAST")
    return {n: doc.select(F.inline(F.col(f"`{n}`"))) for n in schemas}


def snapshot_text(tables: dict[str, DataFrame]) -> Iterator[str]:
    """The JSON document bit by bit; the driver holds one partition of records at a time. Null fields are written."""
    yield "{"
    for k, (name, df) in enumerate(tables.items()):
        yield ("," if k else "") + json.dumps(name, ensure_ascii=False) + ":["
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("r")).toLocalIterator()
        for i, r in enumerate(rows):
            yield ("," if i else "") + r["r"]
        yield "]"
    yield "}"


def save_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Write the store beside ``path``, then put it in its place; ``tables`` may read from ``path``.

    Between the two moves no file is at ``path``; the store that was there is then at ``path``.old-..., where ``recover_store`` finds it.
    """
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write_file(spark, new, snapshot_text(tables))
    had = file_size(spark, path) is not None
    if had:
        move(spark, path, old)
    move(spark, new, path)
    if had:
        delete(spark, old)


def state(spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None) -> str:
    """missing, empty, corrupt or valid: one JSON object of arrays, of any size, and with ``schemas`` of tables that can be read as declared.

    The file is parsed by the reader that reads it later; other failures of the job are raised, not taken for a bad file.
    """
    size = file_size(spark, path)
    if size is None:
        return "missing"
    if size == 0:
        return "empty"
    how = {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    if schemas is None:
        kind = spark.read.json(path, **how).schema
        first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim(F.col("value")), 1, 1)).first()
        ok = first is not None and first[0] == "{" and all(f.name != BAD and isinstance(f.dataType, T.ArrayType) for f in kind)
    else:
        whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()]).add(BAD, "string")
        rows = spark.read.schema(whole).json(path, **how).select(F.col(BAD).isNotNull().alias("bad"), *[F.size(F.col(f"`{n}`")) for n in schemas]).collect()
        ok = len(rows) == 1 and not rows[0]["bad"]
    return "valid" if ok else "corrupt"


def choose_store(spark: SparkSession, preferred: str, fallback: str, seed: dict[str, DataFrame] | None = None, schemas: dict[str, T.StructType] | None = None) -> tuple[str, str]:
    """(path, which) of the store to read: the preferred one if valid, else the fallback if valid, else the fallback made anew from ``seed``.

    The preferred file is never changed. A fallback that is there but not valid is first moved to a backup, bytes as they were. With ``schemas``
    (by default those of ``seed``), a store is valid if its tables can be read as declared there.
    """
    if schemas is None and seed:
        schemas = {n: df.schema for n, df in seed.items()}
    if state(spark, preferred, schemas) == "valid":
        return preferred, "preferred"
    if state(spark, fallback, schemas) == "valid" or recover_store(spark, fallback, seed or {}, schemas) == "old":
        return fallback, "fallback"
    return fallback, "seed"


def recover_store(spark: SparkSession, path: str, seed: dict[str, DataFrame], schemas: dict[str, T.StructType] | None = None) -> str | None:
    """Make the store at ``path`` valid: None if it is; "old" if there was none and the latest valid one that a broken off write had
    moved aside is put back; else it is made from ``seed``, and the backup's path, or "seed" without a bad file, is returned."""
    now = state(spark, path, schemas)
    if now == "valid":
        return None
    if now == "missing":
        for left in siblings(spark, f"{path}.old-*"):
            if state(spark, left, schemas) == "valid":
                move(spark, left, path)
                return "old"
        save_snapshot(spark, seed, path)
        return "seed"
    backup = f"{path}.bad-{uuid.uuid4().hex}"
    move(spark, path, backup)
    save_snapshot(spark, seed, path)
    return backup
