"""From raw documents to token ids: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes all that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.decontaminate import phrase_matches, row_key
from scriptoria.llm.lines import drop_repeated_lines
from scriptoria.llm.minhash import near_duplicates
from scriptoria.llm.pieces import encode_texts
from scriptoria.llm.scratch import collected, stored
from scriptoria.llm.toxicity import crc_left, toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of dropped documents up to which they are broadcast; beyond, both sides are shuffled.
MAX_BROADCAST = 500_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    gone = stored(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone, on, "left_anti")


def _fresh(stage: Stage) -> Stage:
    """``stage``, begun with heaps that hold nothing of the stage before."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_fresh
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. A null text scores as an empty one; rows with a null doc_id are scored like others; repeated rows each have the same score; an empty table gives none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.select(*COLUMNS).withColumn("key", row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    scored = toxicity_scores(keyed, labels, crc_left(F.col("doc_id"), 3) == 1, carry=("key",))
    return _without(keyed, scored.where("score >= 0.7").select("key").distinct(), "key").select(*COLUMNS)


@_fresh
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go, and documents of which no line is left; n_chars is that of the new text. Null texts stay as they are; rows equal in doc_id and text have the same result; an empty table gives none."""
    out = drop_repeated_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where("n_removed = 0 or text <> ''").withColumn("n_chars", changed).select(*COLUMNS)


@_fresh
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays. Rows that share a doc_id stay or go together; those with a null one stay."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return _without(docs.select(*COLUMNS), gone, "doc_id")


@_fresh
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten-word window of a benchmark item go. Null and empty texts stay; rows equal in doc_id and text stay or go together; an empty table gives none."""
    keyed = docs.select(*COLUMNS).withColumn("key", row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    texts = keyed.select("key", F.coalesce("text", F.lit("")).alias("text"))
    matches, _ = phrase_matches(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return _without(keyed, matches.select("key").distinct(), "key").select(*COLUMNS)


@_fresh
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every text, and whether they decode to it, a word-boundary mark read as a space. A null text counts as empty; repeated rows each give a row, an empty table none."""
    out = encode_texts(docs, carry=("doc_id", "text", "lang", "source"))
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]
#: A trained model, minima and merge procedures take part: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
