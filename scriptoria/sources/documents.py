"""A tree of document files, and their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to ``folder`` with "/" between, length) of every file, those in subfolders too. Contents are not read; empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return files.select(path.alias("full"), "length").select(F.substr("full", F.instr("full", F.lit(root + "/")) + len(root) + 1).alias("path"), "length")


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text: what form feeds separate."""
    return content.decode("utf-8", "replace").split("\f")


def extract_pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]] = text_pages) -> DataFrame:
    """(path, pages, error) of every file in the tree; ``extract`` makes pages of a file's bytes, so formats such as PDF need a function that brings its own library.

    A file at which ``extract`` fails has no pages, and what it raised as its error; the others' error is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))

    def tried(content: bytes) -> tuple[list[str], str | None]:
        try:
            return extract(content), None
        except Exception as e:  # whatever a library raises at a broken file
            return [], f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [tried(bytes(c)) for c in part["content"]]
            yield pd.DataFrame({"path": part["path"], "pages": [p for p, _ in got], "error": pd.Series([e for _, e in got], dtype=object)})

    named = files.select(F.substr(path, F.instr(path, F.lit(root + "/")) + len(root) + 1).alias("path"), "content")
    return named.mapInPandas(run, "path string, pages array<string>, error string")
