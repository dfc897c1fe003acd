"""Registered queries over the test tables, each with DuckDB SQL for the same rows.

The documents there have no pages; a line stands in for one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.operators.report import parse_report, report_blocks
from scriptoria.operators.term_scan import in_path_order, page_counts, page_rows, paged, term_scan
from scriptoria.sources.files import write_file
from scriptoria.sources.snapshot import choose_store, read_snapshot, save_snapshot

TERMS = ["the", "Abstract", "license", "und", "erstre"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan(documents(spark, sf_dir), "doc_id", TERMS)


def scan_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan(documents(spark, sf_dir), "doc_id", TERMS, cap=None, case_sensitive=False, snippet="match")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_blocks(scan(spark, sf_dir), "doc_id")


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_report(report_lines(spark, sf_dir))


def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in path order with their numbers; the sources are few, and so is what the window gets."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.count("*").alias("n_docs"))
    return in_path_order(sources, "source").withColumn("place", F.row_number().over(Window.orderBy("source")))


def _folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp()
    return f"{found}/stores-{uuid.uuid4().hex}"


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation")}
    path = f"{_folder(spark)}/snapshot.json"
    save_snapshot(spark, tables, path)
    back = read_snapshot(spark, path, {n: df.schema for n, df in tables.items()})
    return back["nation"].join(back["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred store is cut short, so the fallback is read."""
    region, folder = spark.read.parquet(f"{sf_dir}/region.parquet"), _folder(spark)
    write_file(spark, f"{folder}/snapshot.json", ['{"region":[{"r_regionkey":1'])
    save_snapshot(spark, {"region": region}, f"{folder}/fallback.json")
    path, which = choose_store(spark, f"{folder}/snapshot.json", f"{folder}/fallback.json")
    return read_snapshot(spark, path, {"region": region.schema})["region"].withColumn("which", F.lit(which))


QUERIES = {
    "term_scan": scan,
    "term_scan_uncapped": scan_uncapped,
    "document_pages": lambda s, d: page_rows(documents(s, d), "doc_id"),
    "page_counts": lambda s, d: page_counts(documents(s, d), "doc_id"),
    "term_report_lines": report_lines,
    "term_report_roundtrip": report_roundtrip,
    "path_order": path_order,
    "snapshot_roundtrip": snapshot_roundtrip,
    "source_fallback": source_fallback,
}

_TERMS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))


def _scan_sql(where: str, snippet: str, hit: str) -> str:
    return rf"""
WITH d AS (SELECT doc_id, str_split(text, chr(10)) a FROM documents),
pg AS (SELECT doc_id, unnest(a) page, generate_subscripts(a, 1) page_no FROM d),
t AS (SELECT * FROM (VALUES {_TERMS}) v(term_ord, term)),
h AS (SELECT doc_id, term_ord, min(page_no) page_no, arg_min({snippet}, page_no) snippet FROM pg JOIN t ON {hit} WHERE {where} GROUP BY ALL),
m AS (SELECT doc_id, max(page_no) pages FROM pg GROUP BY 1),
s AS (SELECT m.doc_id, CAST(pages AS INTEGER) pages, CAST(t.term_ord AS INTEGER) term_ord, t.term, CAST(page_no AS INTEGER) page_no, regexp_replace(snippet, '\s+', ' ', 'g') snippet
  FROM m CROSS JOIN t LEFT JOIN h ON h.doc_id = m.doc_id AND h.term_ord = t.term_ord)
"""


_CAPPED = _scan_sql("page_no <= 24", "page", "contains(page, term)")
ORACLES = {
    "term_scan": _CAPPED + "SELECT * FROM s",
    "term_scan_uncapped": _scan_sql("true", "substr(page, instr(lower(page), lower(term)))", "contains(lower(page), lower(term))") + "SELECT * FROM s",
    "document_pages": "SELECT doc_id, unnest(str_split(text, chr(10))) page, CAST(generate_subscripts(str_split(text, chr(10)), 1) AS INTEGER) page_no FROM documents",
    "page_counts": "SELECT doc_id, CAST(len(str_split(text, chr(10))) AS INTEGER) pages FROM documents",
    "term_report_lines": _CAPPED + """
SELECT doc_id, '=== ' || doc_id || ' ===' || chr(10) || 'pages ' || any_value(pages) || chr(10) || string_agg('[' || term || '] ' || CASE WHEN page_no IS NULL THEN 'not found in first24' ELSE 'page ' || page_no || ': ' || snippet END, chr(10) ORDER BY term_ord) || chr(10) block
FROM s GROUP BY doc_id""",
    "term_report_roundtrip": _CAPPED + "SELECT CAST(doc_id AS VARCHAR) path, pages, term_ord, term, page_no, snippet FROM s",
    "path_order": "SELECT source, n_docs, CAST(row_number() OVER (ORDER BY source) AS INTEGER) place FROM (SELECT source, count(*) n_docs FROM documents GROUP BY source)",
    "snapshot_roundtrip": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "source_fallback": "SELECT r_regionkey, r_name, 'fallback' which FROM region",
}
