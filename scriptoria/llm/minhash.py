"""MinHash near-duplicates: universal hash minima, banding, signature verification, confirmation on full shingle sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.components import components
from scriptoria.llm.groups import over_groups
from scriptoria.llm.kernels import LOWER, Words, mix, ngrams, released, slices, text_bytes
from scriptoria.llm.scratch import bound_batches, stored

#: 32 bands of 4 minima: at a similarity of 0.75 a pair shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
#: Minima in which the signatures of a pair must agree to be a candidate; at 0.75, fewer agree with probability 2e-7.
AGREE = 71
#: Documents of a candidate class are compared in blocks of so many.
BLOCK = 512
#: Columns of the 0/1 matrix that a comparison of two blocks holds at once.
STRIP = 4096


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document, its distinct shingle hashes in ascending order; a text of fewer than k words is one shingle."""
    w = Words(LOWER[raw], off)
    h = w.hashes()
    full = mix(ngrams(h, k))
    for i, n in enumerate(w.per_doc.tolist()):
        at = w.first[i]
        if n >= k:
            yield np.unique(full[at : at + n - k + 1])
        elif n:
            yield mix(ngrams(h[at : at + n], n)[:1] + np.uint64(n))
        else:
            yield h[:0]


def signatures(docs: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, digest (16 bytes of the set; null if empty), signature (one long a band of 16-bit hashes of its ``rows`` minima, 4 at most; empty if the set is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            sizes, digests, keys, ends = [], [], [], [0]
            for i, j in slices(off):
                for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k):
                    sizes.append(len(s))
                    if len(s):
                        least = np.full(len(a), 2**64 - 1, np.uint64)
                        for x in range(0, len(s), 4096):
                            m = np.multiply.outer(s[x : x + 4096], a)
                            m += b
                            np.minimum(least, m.min(0), out=least)
                        lanes = mix(least) >> np.uint64(48)
                        keys.append(sum((lanes[r::rows] << np.uint64(16 * r) for r in range(rows)), np.zeros(bands, np.uint64)).view(np.int64))
                        digests.append(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)]).tobytes())
                        ends.append(ends[-1] + bands)
                    else:
                        digests.append(None)
                        ends.append(ends[-1])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, signature array<long>")


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose intersection has at least ``percent`` hundredths of their union; within ``a`` if b is None.

    Intersections are products of 0/1 matrices over the shingles that occur more than once.
    """
    sets = a if b is None else a + b
    size = np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = count[inverse] > 1
    row, col = row[keep], shared[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n, m, width = len(a), len(sets), int(shared[-1]) + 1 if len(shared) else 0
    inter = np.zeros((n, m if b is None else m - n), np.float32)
    for x in range(0, width, STRIP):
        i, j = np.searchsorted(col, [x, x + STRIP])
        part = np.zeros((m, min(STRIP, width - x)), np.float32)
        part[row[i:j], col[i:j] - x] = 1
        inter += part[:n] @ (part if b is None else part[n:]).T
    other = size if b is None else size[n:]
    hit = (100 + percent) * inter.astype(np.int64) >= percent * (size[:n, None] + other[None, :])
    if b is None:
        hit = np.tril(hit, -1)
    return np.nonzero(hit)


def forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the links (x, y) between n nodes, those that first join two trees."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = root(i), root(j)
        if p != q:
            up[p] = q
            out.append((i, j))
    return out


def lanes(column: pa.Array, bands: int) -> np.ndarray:
    """Signatures as rows of 16-bit numbers, 4 a band."""
    return column.flatten().to_numpy().reshape(len(column), bands).view(np.uint16)


def agreeing(pairs: DataFrame, bands: int, least: int) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, mine, other: their signatures) that agree in ``least`` minima or more; lanes that a band does not use agree always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (lanes(batch.column("mine"), bands) == lanes(batch.column("other"), bands)).sum(1) >= least
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[same]) for c in "ab"], names=["a", "b"])

    return pairs.select("a", "b", "mine", "other").mapInArrow(released(run), "a long, b long")


def verified(reps: DataFrame, bands: int, least: int, parts: int) -> DataFrame:
    """(a, b): links that join all of ``reps`` (rep, signature) that share a band and agree in ``least`` minima; fewer than all such pairs.

    1. Each document is compared with the least of each band it shares. 2. Of bands whose documents are not all joined by
    that, those that are not in the least one's component are compared, in blocks of BLOCK, with all of the band that are in another component. A block returns a
    spanning forest. So a band of many copies, however hot, costs a comparison for each with its least one and with the strays.
    """
    keyed = reps.select("rep", F.posexplode("signature").alias("at", "band")).select("rep", F.xxhash64("at", "band").alias("key"))
    centres = stored(keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).where("centre <> other").select("key", "centre"), "centres")
    shared = stored(keyed.join(centres, "key"), "shared")
    pointers = shared.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    pointers = pointers.join(reps.select(F.col("rep").alias("a"), F.col("signature").alias("mine")), "a").join(reps.select(F.col("rep").alias("b"), F.col("signature").alias("other")), "b")
    near = stored(agreeing(pointers, bands, least), "near")
    roots = stored(components(near), "roots")
    members = shared.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    members = stored(members, "members")
    mixed = members.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("last")).where("main <> last").select("key", "main")
    strays = members.join(mixed, "key").withColumn("stray", F.col("root") != F.col("main"))
    strays = stored(strays.select("key", "rep", "root", "stray"), "strays")
    blocks = strays.groupBy("key").agg(F.expr(f"(count_if(stray) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    dealt = strays.join(blocks, "key").withColumn("own", F.expr("case when stray then pmod(xxhash64(rep), blocks) else -1 end"))
    dealt = dealt.select("rep", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "key")
    dealt = dealt.select("rep", "root", F.xxhash64("key", "block").alias("task"), (F.col("own") == F.col("block")).alias("low")).join(reps, "rep")

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        task, rep, root = (group.column(c).to_numpy() for c in ("task", "rep", "root"))
        low, sig = group.column("low").to_numpy(zero_copy_only=False), lanes(group.column("signature"), bands)
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        out: list[tuple[int, int]] = []
        for i, j in zip(cuts, cuts[1:]):
            mine = np.flatnonzero(low[i:j]) + i
            found = []
            for x in range(i, j, BLOCK):
                y = min(x + BLOCK, j)
                near = root[mine][:, None] != root[None, x:y]
                p, q = np.nonzero(near)
                for z in range(0, len(p), 1 << 16):
                    same = (sig[mine[p[z : z + (1 << 16)]]] == sig[x + q[z : z + (1 << 16)]]).sum(1) >= least
                    found.append((mine[p[z : z + (1 << 16)]][same] - i, x + q[z : z + (1 << 16)][same] - i))
            if found:
                p, q = (np.concatenate(c) for c in zip(*found))
                out += [(int(rep[i + a]), int(rep[i + b])) for a, b in forest(p, q, j - i)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return near.unionByName(over_groups(dealt, "task", compare, "a long, b long", parts, many=True))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, agree: int = AGREE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than white space, with A-Z lower-cased; a document's set has
    its distinct k-word shingles, or its whole sequence as one if it is shorter.
    Documents are linked if the intersection of their sets has ``percent`` hundredths of the union at least.

    1. One scan gives each document's set size, set digest and signature. Equal
       sets collapse onto their least doc_id, by partial aggregation.
    2. Of documents that share a band, signatures are compared (``verified``); those that agree in ``agree`` minima are
       joined. Components of these links are the candidate classes.
    3. Within a class every pair of different sets is confirmed on the full
       sets, as products of 0/1 matrices, block against block, each pair of blocks a
       task of its own. A pair of blocks returns a spanning forest of its
       links: fewer rows than documents, and the same components as all links.
    4. Components of the confirmed links.

    Nulls and texts without words have n_shingles 0 and are a component of
    their own. Rows that share a doc_id are one document for linking. A null doc_id takes
    no part in linking: component_id null, kept. An empty table gives no rows. A very long text is one row, and its set
    one more, of 8 bytes a shingle, in each task that confirms it.
    """
    if rows > 4:
        raise ValueError("a band has 4 minima at most")
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sig = stored(signatures(docs, k, bands, rows), "signatures")
    known = sig.where("doc_id is not null and digest is not null")
    reps = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "reps")
    ids = known.join(reps.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # a document with several sets is in links by any of them
    classes = components(stored(verified(reps.select("rep", "signature"), bands, agree + bands * (4 - rows), parts), "candidates"))
    sizes = stored(classes.groupBy("root").agg(F.count("*").alias("n")), "classes")
    block = F.expr(f"cast(pmod(xxhash64(node), (n + {BLOCK - 1}) div {BLOCK}) as int)")
    tasks = classes.join(sizes, "root").withColumn("block", block).withColumn("blocks", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)"))
    tasks = tasks.select("node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("node", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") <= F.col("other")).alias("low"))
    tasks = stored(tasks, "tasks")
    # one text for each set: that of the least document that has it
    nodes = stored(tasks.select("node").distinct(), "nodes")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            out = [s.tobytes() for i, j in slices(off) for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "shingles"])

    def confirm(group: pa.RecordBatch) -> pa.RecordBatch | None:
        node = group.column("node").to_numpy()
        low = group.column("low").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        if len(sets) < 2:
            return None
        if low.all():
            x, y = linked(sets, None, percent)
        else:
            p, q = np.flatnonzero(low), np.flatnonzero(~low)
            x, y = linked([sets[i] for i in p], [sets[i] for i in q], percent)
            x, y = p[x], q[y]
        kept = forest(x, y, len(sets))
        if not kept:
            return None
        i, j = np.array(kept).T
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    sets = texts.mapInArrow(released(cut), "node long, shingles binary")
    links = over_groups(sets.join(tasks, "node"), "task", confirm, "a long, b long", parts)
    roots = components(links.unionByName(ids))
    roots = roots.select(F.col("node").alias("doc_id"), "root")
    out = sig.select("doc_id", "n_shingles").join(roots, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) sh FROM d),
e AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM s),
i AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n + b.n) n, count(*) c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * c >= 75 * (n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id node, doc_id reached FROM documents UNION SELECT r.node, t.b FROM r JOIN t ON r.reached = t.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, component_id, s.doc_id = component_id kept
FROM s JOIN (SELECT node, min(reached) component_id FROM r GROUP BY 1) ON node = s.doc_id
"""
