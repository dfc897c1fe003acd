"""Scan of paged documents for a fixed list of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.pages import first_page, one_line

#: Pages of a document that are scanned.
PAGE_CAP = 24


def paged(docs: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """``docs`` with an array column pages: its text cut at ``separator``. A null text has no pages."""
    return docs.withColumn("pages", F.coalesce(F.split(F.col(text), separator, -1), F.array().cast("array<string>")))


def page_rows(docs: DataFrame, key: str) -> DataFrame:
    """(key, page_no from 1, page): one row a page."""
    return docs.select(key, F.posexplode("pages").alias("at", "page")).select(key, (F.col("at") + 1).alias("page_no"), "page")


def page_counts(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.size("pages").alias("pages"))


def term_scan(docs: DataFrame, key: str, terms: list[str], cap: int | None = PAGE_CAP, case_sensitive: bool = True, snippet: str = "page") -> DataFrame:
    """(key, pages, term_ord from 0, term, page_no, snippet) for every document and term, found or not.

    The first of the first ``cap`` pages (all, if None) that contains the term gives page_no and, on one
    line, snippet: the "page", or what is left of it from the "match" on. Both are null for
    a miss. Terms are literal, may repeat and keep their order; without any, a document has one row with a null term. The plan is one
    narrow stage without an exchange; pages stay in their document's row. The cap goes along as metadata of page_no, for the report.
    """
    if snippet not in ("page", "match"):
        raise ValueError("snippet is page or match")
    listed = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    rows = docs.select(key, F.size("pages").alias("pages"), (F.slice("pages", 1, cap) if cap is not None else F.col("pages")).alias("head"), F.posexplode_outer(listed).alias("term_ord", "term"))
    rows = rows.withColumn("page_no", first_page(F.col("head"), F.col("term"), case_sensitive))
    page = F.get("head", F.col("page_no") - 1)
    if snippet == "match":
        fold = (lambda c: c) if case_sensitive else F.lower
        page = F.substr(page, F.instr(fold(page), fold(F.col("term"))))
    return rows.select(key, "pages", "term_ord", "term", F.col("page_no").alias("page_no", metadata={"cap": cap or 0}), one_line(page).alias("snippet"))


def in_path_order(docs: DataFrame, path: str) -> DataFrame:
    """Rows by path, in the order of code points."""
    return docs.orderBy(path)
