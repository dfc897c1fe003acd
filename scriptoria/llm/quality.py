"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.kernels import slices, text_bytes
from scriptoria.llm.scratch import stored
from scriptoria.llm.toxicity import crc_left

#: Filters, the bytes each sees, the bytes between its places, and the places of a chunk and of its overlap with the next.
FILTERS, WIDTH, STRIDE, CHUNK, OVERLAP = 16, 6, 2, 128, 16
#: A byte counts as an echo if the 4 bytes that begin there also began at most so many bytes before; a text's first so many never do.
ECHO = 32
SYMBOLS = 513  # byte, byte and echo, and the padding before and after a text
#: Labelled rows at most on which the network is trained, passes over them, documents a step.
FIT_ROWS, STEPS, BATCH = 4000, 1500, 16
#: Bytes of text at most that come to the driver for training; rows beyond are left out, in the order of a hash of doc_id.
FIT_BYTES = 64 << 20


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The network's input, padded on either side of each text, and the offsets of the padded texts."""
    four = raw.astype(np.uint32)
    for k in (1, 2, 3):
        byte = np.append(raw, np.zeros(k, np.uint8))[k:].astype(np.uint32)
        for d in range(1, k + 1):  # bytes of the text after this one do not count
            at = off[1:] - d
            byte[at[at >= off[:-1]]] = 0
        four |= byte << np.uint32(8 * k)
    echo = np.zeros(len(raw), bool)
    for d in range(2, ECHO + 1):
        echo[d:] |= four[d:] == four[:-d]
    for d in range(ECHO):  # a text's first bytes could echo the text before
        at = off[:-1] + d
        echo[at[at < off[1:]]] = False
    pad = WIDTH
    n = np.diff(off)
    to = np.append(0, np.cumsum(n + 2 * pad))
    out = np.full(to[-1], SYMBOLS - 1, np.int16)
    shift = np.repeat(to[:-1] + pad - off[:-1], n)
    out[np.arange(len(raw)) + shift] = raw.astype(np.int16) + 256 * echo
    return out, to


def chunk_starts(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (symbol indices) at which filters are applied, the first place of each chunk with the last beside, chunks of each text.

    Chunks have CHUNK places and overlap by OVERLAP; together they cover the text.
    """
    places = [np.arange(a, b - WIDTH + 1, STRIDE) for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
    sizes = np.array([len(p) for p in places])
    begin = np.append(0, np.cumsum(sizes))
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    first = np.concatenate([begin[i] + step * np.arange(c) for i, c in enumerate(counts.tolist())]) if len(counts) else np.zeros(0, np.int64)
    last = np.minimum(first + CHUNK, np.repeat(begin[1:], counts))
    return (np.concatenate(places) if places else np.zeros(0, np.int64)), np.stack([first, last], axis=1), counts


def pooled(x: np.ndarray, places: np.ndarray, chunks: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, rectified; and the responses."""
    z = filters[0][x[places]]
    for k in range(1, WIDTH):
        z += filters[k][x[places + k]]
    edges = chunks.ravel()
    if len(edges) and edges[-1] == len(z):
        best = np.maximum.reduceat(z, edges[:-1])[::2]
    else:
        best = np.maximum.reduceat(z, edges)[::2]
    return np.maximum(best + bias, 0), z


def summary(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's mean and largest pooled response over its chunks."""
    first = np.append(0, np.cumsum(counts))[:-1]
    return np.concatenate([np.add.reduceat(h, first) / counts[:, None], np.maximum.reduceat(h, first)], axis=1)


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    """Filters and weights fitted by Adam to the logistic loss on whole texts; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    p = {"filters": rng.normal(0, 0.3, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.append(order, rng.permutation(len(texts)))
        take, order = order[:BATCH], order[BATCH:]
        own = [texts[i] for i in take]
        off = np.append(0, np.cumsum([len(t) for t in own]))
        x, to = symbols(np.frombuffer(b"".join(own), np.uint8), off)
        places, chunks, counts = chunk_starts(to)
        h, z = pooled(x, places, chunks, p["filters"], p["bias"])
        s = summary(h, counts)
        d = (1 / (1 + np.exp(-np.clip(s @ p["w"] + p["b"], -30, 30))) - labels[take]) / len(take)
        g = {"w": s.T @ d, "b": np.array([d.sum()])}
        ds = d[:, None] * p["w"][None, :]
        doc = np.repeat(np.arange(len(counts)), counts)
        dh = ds[doc, :FILTERS] / counts[doc, None]
        dh += np.where(h == s[doc, FILTERS:], ds[doc, FILTERS:], 0)
        dh *= h > 0
        g["bias"] = dh.sum(0)
        grad = np.zeros_like(p["filters"])
        c, f = np.nonzero(dh)
        spot = np.array([a + int(z[a:b, j].argmax()) for (a, b), j in zip(chunks[c].tolist(), f.tolist())], np.int64)
        for k in range(WIDTH):
            np.add.at(grad[k], (x[places[spot] + k], f), dh[c, f])
        g["filters"] = grad
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p


def scores(raw: np.ndarray, off: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    x, to = symbols(raw, off)
    places, chunks, counts = chunk_starts(to)
    h, _ = pooled(x, places, chunks, p["filters"], p["bias"])
    return 1 / (1 + np.exp(-np.clip(summary(h, counts).astype(np.float64) @ p["w"] + p["b"], -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, fit_rows: int = FIT_ROWS, steps: int = STEPS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and score, the probability that its quality label is 1; other columns are ignored.

    ``labels`` has doc_id and quality; rows with ``held_out`` true (a condition on doc_id) or a
    null in either are not learned from. The network is trained on the driver on at most ``fit_rows`` labelled
    rows of FIT_BYTES of text, chosen by a hash of doc_id; every text is scored whole, in overlapping chunks. Null and
    empty texts are padding alone and get its score. Without labels every score is 0.5. Repeated rows each give a row.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    if held_out is not None:
        known = known.where(~held_out)
    known = stored(known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "quality").limit(fit_rows), "labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").orderBy("order", "doc_id", "quality", "text").limit(fit_rows)
    before = Window.orderBy("order", "doc_id", "quality", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of fit_rows rows at most
    sample = sample.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(before)).where(F.col("bytes") <= FIT_BYTES).select("text", "quality").toArrow()
    net = None
    if sample.num_rows:
        texts = [(t or "").encode() for t in sample.column("text").to_pylist()]
        net = train(texts, (sample.column("quality").to_numpy() == 1).astype(np.float32), steps)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            score = np.full(batch.num_rows, 0.5)
            if shared.value is not None:
                for i, j in slices(off, 1 << 20):
                    score[i:j] = scores(raw[off[i] : off[j]], off[i : j + 1] - off[i], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    left_out = crc_left(F.col("doc_id"), 5) == 0
    out = quality_scores(docs, labels, left_out)
    return out.select("doc_id", left_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
