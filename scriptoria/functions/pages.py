"""Columns over a document's array of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    """White space, line breaks too, collapsed to single spaces."""
    return F.regexp_replace(text, r"\s+", " ")


def first_page(pages: Column, term: Column, case_sensitive: bool = True) -> Column:
    """Number, from 1, of the first page that contains the term as it stands (no pattern); null if none does. Null pages contain nothing."""
    fold = (lambda c: c) if case_sensitive else F.lower
    hits = F.transform(pages, lambda p: F.coalesce(F.contains(fold(p), fold(term)), F.lit(False)))
    return F.nullif(F.array_position(hits, True), F.lit(0).cast("long")).cast("int")
