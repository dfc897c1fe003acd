"""Line dedup: overlapping three-line windows that were seen before go, with all the lines they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.scratch import stored


def repeated_lines(docs: DataFrame, height: int = 3) -> DataFrame:
    """(key, gone) for ``docs`` (key struct<doc_id, digest>, text): the line numbers, from 0, that later occurrences cover."""
    lines = F.split("text", "\n", -1)
    rows = docs.where("text is not null").select("key", lines.alias("lines")).where(F.size("lines") >= height)
    at = F.sequence(F.lit(0), F.size("lines") - height)
    window = lambda i: F.md5(F.array_join(F.slice("lines", i + 1, height), "\n").cast("binary"))
    windows = rows.select("key", F.posexplode(F.transform(at, window)).alias("pos", "hash"))
    windows = windows.withColumn("hash", F.unhex("hash"))
    place = F.struct(F.col("key.doc_id").isNull().alias("last"), "key", "pos")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").select("hash", F.col("first.key").alias("first_key"), F.col("first.pos").alias("first_pos"))
    first = stored(first, "windows")
    later = windows.join(first, "hash").where("key <> first_key or pos <> first_pos").select("key", "pos")
    spots = later.groupBy("key").agg(F.collect_set("pos").alias("begins"))
    return spots.select("key", F.array_distinct(F.flatten(F.transform("begins", lambda b: F.sequence(b, b + height - 1)))).alias("gone"))


def drop_repeated_lines(docs: DataFrame, height: int = 3) -> DataFrame:
    """``docs`` with every column, ``text`` without repeated lines, and n_lines and n_removed beside.

    Lines are what "\\n" separates. A window is ``height`` consecutive lines of a text; of equal
    windows (by 128-bit digest) the first stays, by doc_id (nulls last), then a hash of the text, then line number,
    and all lines that any later one covers go. So lines of a window that stays go too if a later window covers them.
    Rows equal in doc_id and text are one document: each row gets the same result. A null text stays null,
    with no lines; a text of fewer lines than a window stays as it is; a text whose every line
    goes becomes empty. Columns of ``docs`` named n_lines or n_removed are replaced; __key and __gone are refused (ValueError). An empty table gives no rows.
    A text is one row with an array of its lines; what a very long one takes grows with its length.

    The window table is aggregated, then joined back by digest; as the first
    occurrences were written before, adaptive execution can split a digest that a third of the rows have. Texts move once.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    if {"__key", "__gone"} & set(names):
        raise ValueError("rename the columns __key and __gone")
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    gone = repeated_lines(docs.select(key.alias("key"), "text"), height)
    other = gone.select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    out = docs.join(other, key == F.col("__key"), "left")
    lines = F.split("text", "\n", -1)
    # the outer array has one element, so that the text is split once and not for each line
    numbered = F.transform(F.array(lines), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "__gone"), lambda i: F.get(ls, i)))
    left: Column = F.array_join(F.get(numbered, F.lit(0)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    n_removed = F.coalesce(F.size("__gone"), F.lit(0))
    kept = [F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    return out.select(*kept, n_lines.cast("long").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("numberedsha256"))


OP7_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, str_split(text, chr(10)) a FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, unnest(range(0, len(a) - 2)) pos, unnest(list_transform(range(0, len(a) - 2), lambda i: array_to_string(a[i + 1 : i + 3], chr(10)))) win FROM d WHERE len(a) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, text, pos) rn FROM w),
g AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) line FROM r WHERE rn > 1),
k AS (SELECT doc_id, text, list(line) gone FROM g GROUP BY doc_id, text)
SELECT o.doc_id, CAST(CASE WHEN o.text IS NULL THEN 0 ELSE len(str_split(o.text, chr(10))) END AS BIGINT) n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) n_removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(o.text, '') ELSE array_to_string(list_filter(str_split(o.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) numberedsha256
FROM documents o LEFT JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text
"""
