"""The scan report as text, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.pages import one_line
from scriptoria.operators.term_scan import PAGE_CAP


def _label(scan: DataFrame, cap: int | None) -> str:
    cap = cap or scan.schema["page_no"].metadata.get("cap", PAGE_CAP)
    return f"first{cap}" if cap else "all"


def report_blocks(scan: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """(key, block): each document's text block, a line for the path, one for the pages, one a term in order, and an empty one.

    Misses name the cap of the scan, or ``cap``; "all" for a scan without. Line breaks and other white space in paths and terms become single
    spaces. A document of a scan without terms has its own two lines.
    """
    term = F.concat(F.lit("["), one_line(F.col("term")), F.lit("] "))
    line = F.when(F.col("page_no").isNull(), F.concat(term, F.lit(f"not found in {_label(scan, cap)}"))).otherwise(F.concat(term, F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), F.coalesce("snippet", F.lit(""))))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("term_ord").isNotNull(), F.struct("term_ord", line.alias("line"))))), lambda x: x["line"])
    head = F.array(F.concat(F.lit("=== "), one_line(F.col(key).cast("string")), F.lit(" ===")), F.concat(F.lit("pages "), F.first("pages").cast("string")))
    return scan.groupBy(key).agg(F.array_join(F.concat(head, lines, F.array(F.lit(""))), "\n").alias("block"))


def write_report(scan: DataFrame, key: str, path: str, cap: int | None = None) -> None:
    """The report at ``path`` as text files whose names and lines follow the order of the keys."""
    report_blocks(scan, key, cap).orderBy(key).select("block").write.mode("overwrite").text(path)


def parse_report(blocks: DataFrame, column: str = "block") -> DataFrame:
    """(path, pages, term_ord, term, page_no, snippet) from report blocks; a line that is no term line gives a null term, a block without such lines one row without a term."""
    lines = F.split(F.col(column), "\n", -1)
    head = blocks.select(F.regexp_extract(F.get(lines, F.lit(0)), r"^=== (.*) ===$", 1).alias("path"), F.regexp_extract(F.get(lines, F.lit(1)), r"^pages (\d+)$", 1).try_cast("int").alias("pages"), F.filter(F.slice(lines, 3, F.size(lines)), lambda x: x != "").alias("lines"))
    rows = head.select("path", "pages", F.posexplode_outer("lines").alias("term_ord", "line"))
    hit = r"^\[(.*?)\] page (\d+): (.*)$"
    miss = r"^\[(.*)\] not found in (?:first\d+|all)$"
    found = F.col("line").rlike(hit)
    return rows.select(
        "path", "pages", "term_ord", F.when(found, F.regexp_extract("line", hit, 1)).when(F.col("line").rlike(miss), F.regexp_extract("line", miss, 1)).alias("term"), F.when(found, F.regexp_extract("line", hit, 2).try_cast("int")).alias("page_no"), F.when(found, F.regexp_extract("line", hit, 3)).alias("snippet")
    )


def read_report(spark, path: str) -> DataFrame:
    """Blocks of a report file or folder of them: what lies between lines that begin a document."""
    text = spark.read.text(path, wholetext=True)
    parts = F.split(F.concat(F.lit("\n"), F.col("value")), r"\n(?==== )", -1)
    return text.select(F.explode(F.filter(parts, lambda x: x.startswith("=== "))).alias("block"))
