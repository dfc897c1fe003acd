"""Lempel-Ziv phrase fingerprints: the phrases of a text's parse, hashed, and the least hashes kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.kernels import mix

#: Least phrase hashes in a fingerprint.
SIZE = 128
#: Ranges of doc_id for each shuffle partition.
RANGES = 8


class Parse:
    """LZ78 parse of a text, code point by code point; ``more`` goes on with it, ``copy`` branches off.

    A phrase is the longest phrase seen before and the next code point. It is
    known by a number that depends only on its text: a 40-bit hash of what comes before its last
    code point, and that code point. So equal phrases of different texts have equal numbers.
    """

    def __init__(self, phrases: dict[int, int] | None = None, at: int = 0):
        self.phrases, self.at = {} if phrases is None else phrases, at

    def copy(self) -> Parse:
        return Parse(self.phrases.copy(), self.at)

    def more(self, codes: list[int]) -> None:
        phrases, at = self.phrases, self.at
        get = phrases.get
        for c in codes:
            key = at + c
            found = get(key)
            if found is None:
                phrases[key] = (((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 24) + 1) << 21
                at = 0
            else:
                at = found
        self.at = at

    def least(self, size: int = SIZE) -> np.ndarray:
        """The least hashes of the phrases, ascending; an unfinished phrase at the end has been seen already and adds none."""
        n = len(self.phrases)
        h = mix(np.fromiter(self.phrases, np.uint64, n)) >> np.uint64(16)
        if n > size:
            h = np.partition(h, size - 1)[:size]
        return np.unique(h)


def code_points(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).tolist()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets: the share of both sides' least hashes that both have. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    least = np.union1d(a, b)[:size]
    return float((np.isin(least, a, assume_unique=True) & np.isin(least, b, assume_unique=True)).sum() / len(least))


def written(h: np.ndarray) -> str:
    """12 hexadecimal digits for each hash."""
    raw = h.astype(">u8").tobytes().hex()
    return "".join(raw[i + 4 : i + 16] for i in range(0, len(raw), 16))


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt by range of doc_id, each range sorted downwards and followed by the row after it, marked ``extra``.

    Bounds of the ranges are quantiles of doc_id, a few for each shuffle partition; the row after a range is the
    first row of the next range below that has any, and of the first range after the last. Those rows,
    one a range, are found by an aggregation and go along as copies. Rows are ordered by doc_id
    downwards, nulls last, then by the hash and the text itself.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES * n
    steps = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, 100 * n)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    # rows at or above bounds[0] are range 0; below the last bound, len(bounds); nulls come last
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    low = F.size(cuts) - F.size(F.filter(cuts, lambda b: b <= F.col("doc_id")))
    own = own.withColumn("at", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(low).cast("int"))
    firsts = own.groupBy("at").agg(F.max_by(F.struct("doc_id", "digest"), F.struct("doc_id", "digest")).alias("first")).collect()
    have = sorted((r["at"], r["first"]["doc_id"], r["first"]["digest"]) for r in firsts)
    own = own.withColumn("extra", F.lit(False))
    if not have:
        return own
    goes = [(have[i - 1][0], have[i][1], have[i][2]) for i in range(len(have))]
    heads = docs.sparkSession.createDataFrame(goes, "to int, head_id long, head_digest long")
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("digest").eqNullSafe(F.col("head_digest"))
    extra = own.join(F.broadcast(heads), same).select("doc_id", "text", "digest", F.col("to").alias("at"), F.lit(True).alias("extra"))
    order = [F.col("at"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("digest").desc_nulls_last(), F.col("text").desc_nulls_last()]
    return own.unionByName(extra).repartition(n, "at").sortWithinPartitions(*order)


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the text's fingerprint, its edited text's, and their likeness.

    The edited text has the last third of the code points (rounded down) replaced by
    as many of the next document's first, or all it has; next is by descending doc_id, nulls
    last, after the last the first, and rows with the same doc_id follow their text's hash. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty and have the empty fingerprint; two empty ones have likeness 1. A
    table of one row follows itself. Repeated rows each give a row, an empty table none.

    The parse of a text and of its edited text share the first two thirds, so that part is
    parsed once. Texts move once, dealt by range of doc_id; a task holds two documents and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None  # the row before, its branch at two thirds, its fingerprint
        for batch in batches:
            for doc_id, text, at, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "extra"))):
                text = text or ""
                if extra and (last is None or last[4] != at):
                    continue
                codes = code_points(text)
                parse = Parse()
                cut = len(codes) - len(codes) // 3
                parse.more(codes[:cut])
                branch = None if extra else parse.copy()
                parse.more(codes[cut:])
                mark = parse.least(size)
                if last is not None and last[4] == at:
                    before_id, before, tail, before_mark, _ = last
                    third = len(before) // 3
                    tail.more(codes[:third])
                    edited = tail.least(size)
                    text_after = before[: len(before) - third] + text[:third]
                    for c, x in zip(out, (before_id, len(before), hashlib.sha256(text_after.encode()).hexdigest(), written(before_mark), written(edited), likeness(before_mark, edited, size), likeness(before_mark, mark, size))):
                        c.append(x)
                last = None if extra else (doc_id, text, branch, mark, at)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
            for c in out:
                c.clear()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs.select("doc_id", "text")).select("doc_id", "text", "at", "extra").mapInArrow(run, schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
