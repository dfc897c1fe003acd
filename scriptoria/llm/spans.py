"""Substring dedup: repeated token windows as edges of a de Bruijn graph, compacted into paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.components import components
from scriptoria.llm.groups import over_groups
from scriptoria.llm.kernels import Words, mix, ngrams, slices, text_bytes
from scriptoria.llm.scratch import stored

#: Words of the anchors by which windows are dealt out: each window goes to its least anchor hash.
ANCHOR = 8
#: Bytes of text whose anchors make up a part, about; a task holds one part at a time.
PART_BYTES = 4 << 20


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + n] for each i, shorter at the end."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[: len(out) - step] = f(out[: len(out) - step], out[step:])
        have += step
    return out


def anchor_words(window: int) -> int:
    """Words of an anchor: a node, of window - 1 words, holds one at least."""
    if window < 2:
        raise ValueError("a window has two words at least")
    return min(ANCHOR, window - 1)


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash at each word, least anchor of the window that begins there, and which words begin a window."""
    k = anchor_words(window)
    left = w.left()
    grams = mix(ngrams(w.hashes(), k))
    grams[left < k] = 2**64 - 1
    return grams, _slide(grams, window - k + 1, np.minimum), left >= window


def homes(grams: np.ndarray, window: int) -> np.ndarray:
    """Least anchor of the node that begins at each word."""
    return _slide(grams, window - anchor_words(window), np.minimum)


def least_anchors(w: Words, window: int) -> np.ndarray:
    """The words at which the least anchor of some window begins."""
    k = anchor_words(window)
    grams, least, begins = anchors(w, window)
    held = np.where(begins, least, np.uint64(0))
    most = _slide(held[::-1], window - k + 1, np.maximum)[::-1]
    return np.flatnonzero((grams == most) & (w.left() >= k) & (most > 0))


#: What a task of an anchor returns: paths (path, head, tail, edges), their occurrences (path, at, key, first, edges), the
#: same in a run that a batch had several times (run, path, at, first, edges), and such runs' places (run, key, first).
FOUND = pa.schema([("path", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("run", pa.binary()), ("key", pa.int64()), ("first", pa.int32()), ("at", pa.int32()), ("edges", pa.int32())])


def _rows(*parts: dict) -> pa.RecordBatch:
    """Rows of FOUND from columns of equal length; those not given are null."""
    sizes = [len(next(iter(x.values()))) for x in parts]
    columns = [pa.concat_arrays([pa.array(x[f.name], f.type) if f.name in x else pa.nulls(n, f.type) for x, n in zip(parts, sizes)]) for f in FOUND]
    return pa.RecordBatch.from_arrays(columns, schema=FOUND)


def _chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in the order of their paths, and where each path begins there; a cycle begins anywhere."""
    start = np.ones(len(following), bool)
    start[following[following >= 0]] = False
    follow, seen = following.tolist(), bytearray(len(following))
    order: list[int] = []
    cuts: list[int] = []
    for e in (*np.flatnonzero(start).tolist(), *np.flatnonzero(~start).tolist()):
        if seen[e]:
            continue
        cuts.append(len(order))
        while e >= 0 and not seen[e]:
            seen[e] = 1
            order.append(e)
            e = follow[e]
    return np.array(order, np.int64), np.array(cuts, np.int64)


def compact(group: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Rows of FOUND for the runs (task, run, words, key, first) of whole tasks.

    A run holds windows whose least anchor is its task, and neighbours from other tasks that touch a node whose least anchor is this one. So
    the task sees every edge at such a node and decides there, alone, whether a path goes on. At all other nodes its paths end.
    """
    texts: dict[tuple, int] = {}
    weight: list[int] = []
    copies: tuple[list, list, list] = ([], [], [])
    single: tuple[list, list, list] = ([], [], [])
    named: dict[int, bytes] = {}
    for t, r, x, k, a in zip(*(group.column(c).to_pylist() for c in ("task", "run", "words", "key", "first"))):
        if x is None:
            for c, y in zip(copies, (r, k, a)):
                c.append(y)
            continue
        u = texts.setdefault((t, x), len(texts))
        weight += [0] * (u == len(weight))
        weight[u] += 1 if r is None else 2
        if r is None:
            for c, y in zip(single, (u, k, a)):
                c.append(y)
        else:
            named[u] = r
    placed = dict(zip(("run", "key", "first"), copies))
    if not texts:
        return _rows(placed)
    blob = b"".join(x for _, x in texts)
    task = np.array([t for t, _ in texts], np.int64).view(np.uint64)
    w = Words(np.frombuffer(blob, np.uint8), np.concatenate([[0], np.cumsum([len(x) for _, x in texts])]))
    grams, least, begins = anchors(w, window)
    home, hashes = homes(grams, window), w.hashes()
    node, edge = mix(ngrams(hashes, window - 1)), mix(ngrams(hashes, window))
    at = np.flatnonzero(begins)
    owner = np.searchsorted(w.first, at, "right") - 1
    known: dict[bytes, int] = {}
    ids = [known.setdefault(blob[a:b], len(known)) for a, b in zip(w.start[at].tolist(), w.end[at + window - 1].tolist())]
    del known
    # an edge is looked at once in each task that has it
    tasks, number = np.unique(task, return_inverse=True)
    _, place, ids = np.unique(np.array(ids, np.int64) * len(tasks) + number[owner], return_index=True, return_inverse=True)
    again = np.bincount(ids, np.array(weight)[owner]) > 1
    chosen = np.flatnonzero(again)
    place = place[chosen]
    spot, of = at[place], task[owner[place]]
    own = least[spot] == of
    _, ends = np.unique(mix(np.concatenate([node[spot], node[spot + 1]]) ^ np.concatenate([of, of])), return_inverse=True)
    heads, tails = ends[: len(spot)], ends[len(spot) :]
    outs, ins = np.bincount(heads, minlength=len(ends)), np.bincount(tails, minlength=len(ends))
    begun = np.full(len(ends), -1)
    begun[heads] = np.arange(len(spot))
    follow = np.where((outs[tails] == 1) & (ins[tails] == 1) & (home[spot + 1] == of) & own, begun[tails], -1)
    follow[(follow >= 0) & ~own[follow]] = -1
    mine = np.flatnonzero(own)
    back = np.full(len(spot) + 1, -1)
    back[mine] = np.arange(len(mine))
    follow = back[follow[mine]]
    order, cuts = _chains(follow)
    spot = spot[mine]
    sizes = np.diff(np.append(cuts, len(order)))
    last = order[cuts + sizes - 1] if len(cuts) else order
    names = edge[spot[order[cuts]]].view(np.int64)
    paths = {"path": names, "head": node[spot[order[cuts]]].view(np.int64), "tail": node[spot[last] + 1].view(np.int64), "edges": sizes}
    # of each composite edge, its path and place there; -1 if it is not repeated or another task's
    path_of, at_of = np.full(len(again), -1), np.zeros(len(again), np.int64)
    path_of[chosen[mine][order]] = np.repeat(np.arange(len(cuts)), sizes)
    at_of[chosen[mine][order]] = np.arange(len(order)) - np.repeat(cuts, sizes)
    use = np.flatnonzero(path_of[ids] >= 0)
    at, owner, p, o = at[use], owner[use], path_of[ids[use]], at_of[ids[use]]
    # within a task only a cycle follows itself, so a text of one repeated word is one piece
    cycle = np.where(follow[last] == order[cuts], sizes, np.iinfo(np.int64).max) if len(cuts) else cuts
    cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (p[1:] != p[:-1]) | (o[1:] != (o[:-1] + 1) % cycle[p[1:]]))) if len(at) else at
    size = np.diff(np.append(cut, len(at)))
    owner, loc, p, o = owner[cut], at[cut] - w.first[owner[cut]], names[p[cut]], o[cut]

    def pieces(of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text asked for, its pieces: which question, which piece."""
        low, high = np.searchsorted(owner, of_texts), np.searchsorted(owner, of_texts, "right")
        many = high - low
        which = np.repeat(np.arange(len(of_texts)), many)
        return which, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)

    which, x = pieces(np.array(single[0], np.int64))
    occurrences = {"path": p[x], "at": o[x], "key": np.array(single[1], np.int64)[which], "first": np.array(single[2], np.int64)[which] + loc[x], "edges": size[x]}
    which, x = pieces(np.array(list(named), np.int64))
    runs = list(named.values())
    inside = {"run": [runs[i] for i in which.tolist()], "path": p[x], "at": o[x], "first": loc[x], "edges": size[x]}
    return _rows(paths, occurrences, inside, placed)


def repeated_paths(docs: DataFrame, window: int = 35) -> DataFrame:
    """Compacted paths of repeated edges: path, key, first, edges, of ``docs`` (key long, text); ``window`` is 2 or more.

    An edge is a sequence of ``window`` words, from the node of its first
    window - 1 words to that of its last. An edge is repeated if it begins at two
    places, in one document or two; the graph has the repeated edges, each once. A path goes on through a node that one edge
    enters and one leaves. A row is a longest stretch of a document along one path: ``edges`` of its edges from word ``first`` on.

    1. Every window has a least anchor (the least hash of its 8-word
       sequences); equal windows have the same. Anchors that occur once rule out all their windows.
    2. Windows with a repeated anchor are sent to that anchor's task as the
       words of their run, once for equal runs of a batch, so that a passage that
       a third of the documents share arrives once a batch. There, equal edges are found by comparing their words, not
       hashes of them. A node has a least anchor too, and edges of other tasks that touch it are sent there beside, so this task
       compacts paths through its own nodes (``compact``).
    3. Between tasks paths are joined: ends are grouped by node, an end and a beginning that are alone at their node are linked, and
       linked paths are one component (large-star and small-star), whose least name is ``path``.
    4. Source coordinates verify each link: pieces of a document become one stretch only where one begins at the word at which the other
       ends and a link joins them. Names and nodes are 64-bit hashes, on which borders and names depend, but no covered word.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(4 * n, -(-size // PART_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in slices(off):
                w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(w.start):
                    continue
                at = least_anchors(w, window)
                values.append(mix(ngrams(w.hashes(), anchor_words(window)))[at])
                owners.append(keys[i:j][np.searchsorted(w.first, at, "right") - 1])
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v)
            v, o = v[order], o[order]
            first = np.ones(len(v), bool)
            first[1:] = v[1:] != v[:-1]
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(v)))
            one, part = v[at], (v[at] % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            rows: tuple[list, ...] = ([], [], [], [], [])
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                x = by[cuts[p] : cuts[p + 1]]
                for c, y in zip(rows, (p, one[x].tobytes(), o[at[x]].tobytes(), (count[x] > 1).tobytes(), None)):
                    c.append(y)
            again = np.repeat(count > 1, count)
            v, o = v[again], o[again]
            by = np.argsort(o, kind="stable")
            v, o = v[by], o[by]
            cuts = np.flatnonzero(np.append(True, o[1:] != o[:-1])).tolist() + [len(o)] if len(o) else []
            for x, y in zip(cuts, cuts[1:]):
                for c, z in zip(rows, (int(o[x]) % parts, v[x:y].tobytes(), None, None, int(o[x]))):
                    c.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["part", "anchors", "owners", "again", "key"])

    def repeated(group: pa.RecordBatch) -> pa.RecordBatch | None:
        known = [(k, a) for k, a in zip(group.column("key").to_pylist(), group.column("anchors").to_pylist()) if k is not None]
        asks = [(a, o, r) for a, o, r in zip(*(group.column(c).to_pylist() for c in ("anchors", "owners", "again"))) if o is not None]
        keys, found = [k for k, _ in known], [a for _, a in known]
        if asks:
            v = np.frombuffer(b"".join(x[0] for x in asks), np.uint64)
            o = np.frombuffer(b"".join(x[1] for x in asks), np.int64)
            r = np.frombuffer(b"".join(x[2] for x in asks), bool)
            _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
            hit = (count[inverse] > 1) & ~r  # those seen again in their own batch have been answered there
            v, o = v[hit], o[hit]
            by = np.argsort(o, kind="stable")
            v, o = v[by], o[by]
            cuts = np.flatnonzero(np.append(True, o[1:] != o[:-1])).tolist() + [len(o)] if len(o) else []
            keys += [int(o[x]) for x in cuts[:-1]]
            found += [v[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
        if not keys:
            return None
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["key", "anchors"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            keys = batch.column("key").to_pylist()
            wanted = batch.column("anchors").to_pylist()
            seen: dict[tuple, list] = {}
            for i, j in slices(off):
                piece = raw[off[i] : off[j]]
                w = Words(piece, off[i : j + 1] - off[i])
                if not len(w.start):
                    continue
                grams, least, begins = anchors(w, window)
                some = np.unique(np.frombuffer(b"".join(b for x in wanted[i:j] for b in x), np.uint64))
                at = np.flatnonzero(begins)
                at = at[np.isin(least[at], some)]
                if not len(at):
                    continue
                home = homes(grams, window)
                m, head, tail = least[at], home[at], home[at + 1]
                other, third = tail != m, (head != m) & (head != tail)
                m, at = np.concatenate([m, tail[other], head[third]]), np.concatenate([at, at[other], at[third]])
                order = np.lexsort((at, m))
                m, at = m[order], at[order]
                cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1])))
                size = np.diff(np.append(cut, len(at)))
                order = np.argsort(at[cut], kind="stable")
                cut, size = cut[order], size[order]
                doc = np.searchsorted(w.first, at[cut], "right") - 1
                now, words = -1, []
                for a, d, s, v in zip(at[cut].tolist(), doc.tolist(), size.tolist(), m[cut].view(np.int64).tolist()):
                    if d != now:
                        now, words = d, piece[off[i + d] - off[i] : off[i + d + 1] - off[i]].tobytes().split()
                    a -= int(w.first[d])
                    seen.setdefault((v, b" ".join(words[a : a + s + window - 1])), []).append((keys[i + d], a))
            out: tuple[list, ...] = ([], [], [], [], [])
            for (v, text), where in seen.items():
                if len(where) == 1:
                    rows = [(v, None, text, *where[0])]
                else:
                    run = hashlib.md5(v.to_bytes(8, "little", signed=True) + text, usedforsecurity=False).digest()
                    rows = [(v, run, text, None, None), *((k, run, None, k, a) for k, a in where)]
                for row in rows:
                    for c, x in zip(out, row):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()))], names=["task", "run", "words", "key", "first"])

    asked = docs.select("key", "text").mapInArrow(ask, "part long, anchors binary, owners binary, again binary, key long")
    told = over_groups(asked, "part", repeated, "key long, anchors binary", n)
    told = told.groupBy("key").agg(F.collect_list("anchors").alias("anchors"))
    sent = docs.select("key", "text").join(told, "key").mapInArrow(runs, "task long, run binary, words binary, key long, first int")
    found = over_groups(sent, "task", lambda group: compact(group, window), "path long, head long, tail long, run binary, key long, first int, at int, edges int", n, many=True)
    return joined_paths(stored(found, "paths"))


def joined_paths(found: DataFrame) -> DataFrame:
    """path, key, first, edges from rows of FOUND: paths of several tasks joined at their ends, occurrences joined by source coordinates."""
    paths = found.where("head is not null")
    ends = paths.select(F.col("head").alias("node"), F.col("path").alias("b"), F.lit(None).cast("long").alias("a"))
    ends = ends.unionByName(paths.select(F.col("tail").alias("node"), F.lit(None).cast("long").alias("b"), F.col("path").alias("a")))
    alone = ends.groupBy("node").agg(F.count("a").alias("ins"), F.count("b").alias("outs"), F.min("a").alias("a"), F.min("b").alias("b")).where("ins = 1 and outs = 1")
    links = stored(alone.select("a", "b"), "glue")
    glued = links.select(F.col("b").alias("path"), F.lit(True).alias("glued"))
    named = components(links).unionByName(links.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root")))
    roots = stored(named.withColumnRenamed("node", "path").join(glued, "path", "left"), "roots")
    inside = found.where("run is not null and path is not null").select("run", "path", "at", F.col("first").alias("skip"), "edges")
    copies = found.where("run is not null and key is not null").select("run", "key", "first").join(inside, "run")
    places = found.where("path is not null and key is not null").select("path", "at", "key", "first", "edges")
    places = places.unionByName(copies.select("path", "at", "key", (F.col("first") + F.col("skip")).cast("int").alias("first"), "edges")).join(roots, "path", "left")
    order = Window.partitionBy("key").orderBy("first")
    # rows that share a key have the same places
    once = places.withColumn("number", F.row_number().over(order)).withColumn("same", F.lag("first").over(order)).where("number = 1 or same <> first")
    goes_on = F.col("glued") & (F.col("at") == 0) & (F.lag(F.col("first") + F.col("edges")).over(order) == F.col("first"))
    stretch = once.withColumn("stretch", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return stretch.groupBy("key", "stretch").agg(F.min(F.coalesce("root", "path")).alias("path"), F.min("first").alias("first"), F.sum("edges").cast("int").alias("edges")).select("path", "key", "first", "edges")


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` (doc_id, text; other columns stay, but key and spans are replaced) with key and spans: the [first, end) word ranges, sorted,
    that repeated windows of ``window`` words cover.

    Rows equal in doc_id and text share a key; as each of them is a place of
    its own, their windows are repeated. A null or short text has no windows; its spans are null.
    """
    keyed = docs.drop("spans").withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    paths = repeated_paths(keyed, window)
    spans = paths.select("key", F.struct("first", (F.col("first") + F.col("edges") + window - 1).alias("end")).alias("span"))
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return keyed.join(spans, "key", "left")


def covered(spans: list | None) -> list[tuple[int, int]]:
    """Sorted ranges with the touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["first"], s["end"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words that no repeated window covers, joined by one space).

    Words are runs of bytes other than white space, unchanged. Every copy of a repeated window goes, the
    first as well. A null text has no words. An empty table gives no rows; other columns are ignored. A very long text is one row, and its
    words a list of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                left, at = [], 0
                for a, b in covered(spans):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    spans = repeated_spans(docs.select("doc_id", "text"), window)
    return spans.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
v AS (SELECT k, unnest(range(0, len(w) - 34)) p, unnest(list_transform(range(0, len(w) - 34), lambda i: md5(array_to_string(w[i + 1 : i + 35], ' ')))) h FROM d WHERE len(w) >= 35),
g AS (SELECT DISTINCT k, p + o pos FROM v JOIN (SELECT h FROM v GROUP BY h HAVING count(*) > 1) USING (h), range(35) t(o)),
u AS (SELECT k, unnest(range(0, len(w))) pos, unnest(w) word FROM d),
x AS (SELECT u.k, string_agg(word, ' ' ORDER BY u.pos) kept, count(*) n FROM u ANTI JOIN g ON u.k = g.k AND u.pos = g.pos GROUP BY u.k)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN x USING (k)
"""
