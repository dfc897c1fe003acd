"""Jobs: SQLite to snapshot, and document tree to scan report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptoria.operators.report import write_report
from scriptoria.operators.term_scan import term_scan
from scriptoria.sources.documents import extract_pages, text_pages
from scriptoria.sources.snapshot import save_snapshot
from scriptoria.sources.sqlite import read_sqlite, sqlite_tables


def sync_snapshot(spark: SparkSession, database: str, snapshot: str, tables: list[str] | None = None) -> list[str]:
    """Export tables (all, if None) of a SQLite database to one JSON snapshot; their names."""
    names = sqlite_tables(database) if tables is None else tables
    save_snapshot(spark, {n: read_sqlite(spark, database, n) for n in names}, snapshot)
    return names


def scan_tree(spark: SparkSession, folder: str, terms: list[str], report: str, extract: Callable[[bytes], list[str]] = text_pages) -> DataFrame:
    """Scan every document below ``folder`` for ``terms`` and write the report; returns the scan."""
    scan = term_scan(extract_pages(spark, folder, extract), "path", terms)
    write_report(scan, "path", report)
    return scan
