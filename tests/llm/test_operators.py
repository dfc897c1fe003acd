"""The training-data operators against brute force on small tables with every awkward row."""

import hashlib
import os
import re
import struct
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from scriptoria.llm import decontaminate, groups, hilbert, lempel_ziv, lines, lookup, minhash, pieces, quality, queries, revisits, scratch, spans, toxicity
from scriptoria.llm.components import components

DATA = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, key string, score string, label int, spans string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
SHARED = " ".join(f"s{i}" for i in range(60))
BASE = " ".join(f"b{i}" for i in range(100))
TEXTS = [
    (1, SHARED + " one"), (2, "two\t" + SHARED.replace(" ", "\n")), (3, BASE), (3, BASE), (4, BASE.replace("b50 ", "other ")), (5, BASE.upper()),
    (6, ""), (7, None), (8, " \n\t "), (9, "short"), (10, "Short"), (11, "a b c d e"), (12, LONG), (13, "x " * 300), (14, "l1\nl2\nl3\nl4"), (15, "l0\nl1\nl2\nl3"),
    (None, "no id"), (None, BASE), (None, None), (16, "d\nd\nd\nd\nd"), (17, "é É ▁ 中​🎉 \x00 idiot"), (18, "same id one"), (18, "same id two"), (-5, SHARED),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i and i % 3 == 0 else "en", None if i == 4 else "src", None, 99, "k", "s", 1, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, WIDE).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], WIDE)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_hilbert_index_is_a_walk(spark):
    n = 3
    df = spark.range(8**n).selectExpr("cast(id & 7 as int) a", "cast(shiftright(id, 3) & 7 as int) b", "cast(shiftright(id, 6) as int) c")
    got = sorted((tuple(r) for r in df.select(hilbert.hilbert_index([df.a, df.b, df.c], 3), "a", "b", "c").collect()))
    assert [r[0] for r in got] == list(range(8**n))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:])) == 1 for p, q in zip(got, got[1:]))


@pytest.mark.parametrize("shards", [1, 5, 16, 40])
def test_shards(docs, nothing, shards):
    got = hilbert.hilbert_shards(docs, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    texts = Counter((r.size, r.text_crc32) for r in got)
    if shards == 5:
        assert sum(len({r.shard for r in got if (r.size, r.text_crc32) == t}) > 1 for t in texts) < shards
    assert hilbert.hilbert_shards(nothing).count() == 0
    assert hilbert.hilbert_shards(docs, shards, carry=("lang", "key")).select("lang", "key").count() == len(TEXTS)
    with pytest.raises(ValueError):
        hilbert.hilbert_shards(docs, shards, carry=("doc_id",))


def test_shard_files_are_skipped(spark, tmp_path):
    """By the ranges in the files' footers, a reader of one value opens at most twice the files that have it; equal texts are seldom apart."""
    real = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sharded = hilbert.hilbert_shards(real, 16, carry=("text", "lang", "source"))
    hilbert.write_shards(sharded, str(tmp_path / "shards"))
    files = sorted((tmp_path / "shards").glob("shard=*/*.parquet"))
    assert len(files) == 16
    for column in ("lang", "source"):
        kept = held = 0
        tables = [pq.ParquetFile(f) for f in files]
        at = tables[0].schema_arrow.names.index(column)
        ends = [t.metadata.row_group(0).column(at).statistics for t in tables]
        values = [set(t.read([column]).column(0).to_pylist()) for t in tables]
        for v in set().union(*values):
            kept += sum(e.min <= v <= e.max for e in ends)
            held += sum(v in x for x in values)
        assert held <= kept <= 2 * held, (column, kept, held)
    back = spark.read.parquet(str(tmp_path / "shards"))
    groups_ = back.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards")).where("n > 1")
    assert groups_.where("shards > 1").count() <= 15 and groups_.count() > 30
    ranges = {r.shard: r for r in hilbert.shard_ranges(back, ["source", "size"]).collect()}
    assert len(ranges) == 16 and all(r.least_size <= r.most_size for r in ranges.values())


def test_fingerprints(docs, nothing):
    got = defaultdict(list)
    for r in lempel_ziv.fingerprints(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(TEXTS)

    def mark(text):
        p = lempel_ziv.Parse()
        p.more(lempel_ziv.code_points(text))
        return p.least()

    known = sorted(((i, t or "") for i, t in TEXTS if i is not None and i < 16 and i != 3), reverse=True)
    for (i, t), (_, after) in zip(known, known[1:]):
        if i == 4:
            after = BASE
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lempel_ziv.written(mark(t)), lempel_ziv.written(mark(edited)))
        assert r.near_edited == lempel_ziv.likeness(mark(t), mark(edited)) and r.near_next == lempel_ziv.likeness(mark(t), mark(after))
    assert len({r.fingerprint for r in got[3]}) == 1 and lempel_ziv.fingerprints(nothing).count() == 0


def test_phrases_are_those_of_the_parse():
    p = lempel_ziv.Parse()
    p.more(lempel_ziv.code_points("aababcabcd"))
    assert len(p.phrases) == 4  # a, ab, abc, abcd
    q = lempel_ziv.Parse()
    q.more(lempel_ziv.code_points("aab"))
    q.more(lempel_ziv.code_points("abcabcd"))
    assert q.phrases == p.phrases


def test_decontamination(spark, docs, nothing):
    items = [(1, SHARED[:60]), (2, "S3 s4, s5 s6 s7 s8 s9 s10 s11 s12 never"), (2, "short"), (3, "  "), (4, None), (None, BASE), (5, "l1 l2 l3"), (6, "d"), (7, "É"), (8, "absent words only")]
    got = rows(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {(str(i), tuple(w[k : k + 10])) for i, t in items if i is not None for w in [find(t)] if w for k in range(max(1, len(w) - 9))}
    want = Counter()
    for i, t in TEXTS:
        w, hit, names = find(t), set(), set()
        for name, phrase in windows:
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit.update(range(k, k + len(phrase)))
                    names.add(name)
        want[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    assert got == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, empty).count() == 0
    assert decontaminate.contamination(docs, empty).where("contaminated").count() == 0


def test_leaks_with_capital_sigma(spark):
    """Lower-casing a whole text and its words one by one differ in a sigma before . ' or :"""
    texts = [(1, "see ΟΔΟΣ.ΑΒ one two"), (2, "x ΟΔΟΣ'Α y ΟΔΟΣ:Α z"), (3, "Α.Σ. ends"), (4, "nothing here")]
    items = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒ one"), (2, "ΟΔΟΣ'Α Y"), (3, "Α.Σ.")], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 3, 2: 3, 3: 2, 4: 0}


def test_repetitive_texts_align_in_linear_time(spark, monkeypatch):
    """One word 20,000 times, against items that repeat it ten, 600 and two times; chunks of alignments, and tables joined by shuffle."""
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "y x x y"), (3, "x " * 9 + "y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " * 10), (2, "x " * 600), (3, "x x"), (4, "z x x")], "item_id long, text string")
    want = {1: (20_000, 20_000, 3), 2: (4, 2, 1), 3: (10, 9, 1)}
    began = time.time()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect()} == want
    assert time.time() - began < 60
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs.where("doc_id > 1"), items).collect()} == {2: want[2], 3: want[3]}


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x x b x a"), (2, "a b"), (3, "b x x x x x a")], "key long, text string")
    assert rows(decontaminate.proximity_matches(df, "a", "b", 3)) == Counter([(1, 0, 3), (1, 5, 3), (2, 0, 1)])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, nothing):
    known = [(i, shingles(t)) for i, t in TEXTS]
    up = {i: i for i, _ in known if i is not None}
    for _ in range(len(up)):
        for (i, a), (j, b) in combinations([k for k in known if k[0] is not None], 2):
            if i == j or a and 100 * len(a & b) >= 75 * len(a | b):
                up[i] = up[j] = min(up[i], up[j])
    want = Counter((i, len(s), up.get(i), up.get(i) == i) for i, s in known)
    assert rows(minhash.near_duplicates(docs)) == want
    assert minhash.near_duplicates(nothing).count() == 0


def test_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    words = [f"v{i}" for i in range(120)]
    texts = [(100 - k, " ".join(words[:k] + [f"n{k}"] + words[k + 1 :])) for k in range(0, 100, 4)]
    got = {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {4}


@pytest.mark.parametrize("limit", [1, 1 << 30])
def test_groups_keep_all_rows(spark, monkeypatch, limit):
    """Groups of several batches, with and without 64-bit offsets, and the two operators that are made of them."""
    monkeypatch.setattr(groups, "WIDE_BYTES", limit)
    parts = [pa.RecordBatch.from_pydict({"k": [i], "b": [b"x" * i], "t": ["y"]}) for i in range(5)]
    assert groups.joined(parts).to_pydict() == {"k": list(range(5)), "b": [b"x" * i for i in range(5)], "t": ["y"] * 5}
    words = [f"v{i}" for i in range(120)]
    texts = [(k, " ".join(words[:k] + [f"n{k}"] + words[k + 1 :])) for k in range(0, 100, 4)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}
        assert {r.n_removed for r in spans.remove_repeats(df, 3).collect()} == {119}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_signatures_are_verified(spark, monkeypatch):
    """Links among signatures against all pairs that share a band, in blocks of three: the same components, none of weak pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**16, (6, 128), dtype=np.uint16)
    sigs = [np.where(rng.random(128) < keep, base[g], rng.integers(0, 2**16, 128, dtype=np.uint16)) for g in range(6) for keep in (1, 0.9, 0.8, 0.75, 0.7, 0.65, 0.5, 0.4)]
    for x in sigs:
        x[:4] = 7  # one band that all share
    df = spark.createDataFrame([(i, [int(v) for v in x.view(np.int64)]) for i, x in enumerate(sigs)], "rep long, signature array<long>").repartition(4)
    got = {r.node: r.root for r in components(minhash.verified(df, 32, 71, 4)).collect()}
    up = {i: i for i in range(len(sigs))}
    for _ in up:
        for i, j in combinations(up, 2):
            if (sigs[i] == sigs[j]).sum() >= 71:
                up[i] = up[j] = min(up[i], up[j])
    assert {i: got.get(i, i) for i in up} == up and 6 < len(set(up.values())) < 40


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(70, 60), (80, 70), (60, 60), (90, 91), (91, 90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 60: 60, 70: 60, 80: 60, 90: 90, 91: 90}


def test_repeated_spans(docs, nothing):
    def brute(n):
        words = [(t or "").encode().split() for _, t in TEXTS]
        seen = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
        for (i, _), w in zip(TEXTS, words):
            gone = {p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
            yield i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()

    for n in (35, 8, 3):
        assert rows(spans.remove_repeats(docs, n)) == Counter(brute(n))
    assert spans.remove_repeats(nothing).count() == 0


def longest_stretches(texts, n):
    """(key, first, edges) by following every repeated window to the next one, and which stretches share a path."""
    words = {k: t.split() for k, t in texts}
    places = {}
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), []).append((k, i))
    graph = {e for e, at in places.items() if len(at) > 1}
    into, out = Counter(e[1:] for e in graph), Counter(e[:-1] for e in graph)
    for k, w in words.items():
        begin = None
        for i in range(len(w) - n + 2):
            e = tuple(w[i : i + n]) if i + n <= len(w) else None
            if begin is not None and (e not in graph or into[e[:-1]] != 1 or out[e[:-1]] != 1):
                yield k, begin, i - begin
                begin = None
            if begin is None and e in graph:
                begin = i


@pytest.mark.parametrize("n, letters", [(2, 3), (4, 3), (12, 2), (12, 40), (35, 300)])
def test_paths_are_longest_between_branches(spark, n, letters):
    """Paths over many tasks against brute force: random, periodic and copied texts, cycles, branches next to ends."""
    rng = np.random.default_rng(n + letters)
    base = [f"w{x}" for x in rng.integers(0, letters, 400)]
    texts = [" ".join(base), " ".join(base[:200]), " ".join(base[150:] + base[:90]), "a " * 90, "b c " * 60, "x " + " ".join(base[40:140]) + " y", " ".join(base[60:140]) + " y z"]
    texts += [" ".join(base[a : a + 3 * n]) for a in rng.integers(0, 300, 12)] + ["", "a b"]
    rows = [(1000 + k, t) for k, t in enumerate(texts)]
    got = spans.repeated_paths(spark.createDataFrame(rows, "key long, text string").repartition(3), n).collect()
    want = sorted(longest_stretches(rows, n))
    assert sorted((r.key, r.first, r.edges) for r in got) == want and want
    assert len({r.path for r in got}) < len(got)
    twice = spans.repeated_paths(spark.createDataFrame(rows + rows[:1], "key long, text string").coalesce(1), n)
    assert twice.groupBy("key", "first").count().where("count > 1").count() == 0


def test_paths_are_joined_between_tasks(spark):
    """A passage of 600 words in two documents is one path of 566 edges, though its windows have dozens of anchors."""
    passage = " ".join(f"w{x}" for x in range(600))
    got = spans.repeated_paths(spark.createDataFrame([(1, "a " + passage), (2, passage + " b")], "key long, text string"), 35).collect()
    assert {(r.key, r.first, r.edges) for r in got} == {(1, 1, 566), (2, 0, 566)} and len({r.path for r in got}) == 1


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(docs, nothing):
    got = lines.drop_repeated_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert {(r.doc_id, r.text, r.n_removed) for r in got.where("doc_id in (14, 15, 16, 7, 3)").collect()} == {(14, "l1\nl2\nl3\nl4", 0), (15, "l0", 3), (16, "d", 4), (7, None, 0), (3, BASE, 0)}
    assert got.count() == len(TEXTS) and lines.drop_repeated_lines(nothing).count() == 0


def test_revisits(spark):
    h = lambda **x: [{"name": k.replace("_", "-"), "value": v} for k, v in x.items()]
    table = [
        (1, "response", "http://WWW.a.org:80/x/?utm_source=q#f", 10, "d1", h(ETag='"1"', Content_Length="5", Age="0")),
        (2, "response", "https://a.org/x", 20, "d2", h(ETag='W/"2"', Last_Modified="m")),
        (3, "response", "https://a.org/x", 20, "d3", h(ETag='"3"', Last_Modified="m")),
        (10, "revisit", "a.org/x/index.html", 10, None, h(ETag='"1"')),
        (11, "revisit", "a.org/x/", 20, None, h(etag='W/"1"', Age="7", Content_Length="0")),
        (12, "revisit", "a.org/x", 21, None, h(ETag='"2"')),
        (13, "revisit", "a.org/x", 99, None, h(last_modified="m")),
        (14, "revisit", "a.org/x", 99, None, None),
        (15, "revisit", None, 99, None, None),
        (16, "revisit", "a.org/x", None, None, None),
        (17, "response", None, 1, "d", None),
        (17, "revisit", "a.org/x?b=1", 50, None, None),
        (14, "revisit", "a.org/x", 99, None, None),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in table], "record_id long, kind string, url string, ts long, digest string, headers array<struct<name:string,value:string>>, status string")
    for blocks in (1, 3, 64):
        got = revisits.resolve_revisits(df, blocks).collect()
        assert sorted((r.record_id, r.status, r.response_id) for r in got) == [(10, "no_response", None), (11, "resolved", 1), (12, "mismatch", None), (13, "resolved", 3), (14, "resolved", 3), (14, "resolved", 3), (15, "no_response", None), (16, "no_response", None), (17, "no_response", None)]
        one = next(r for r in got if r.record_id == 11)
        assert [tuple(x) for x in one.headers] == [("age", "7"), ("content-length", "5"), ("etag", 'W/"1"')]
    assert revisits.resolve_revisits(df.where("false")).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    got = quality.quality_scores(real, labels, toxicity.crc_left(labels.doc_id, 2) == 0, steps=600).join(labels.where(toxicity.crc_left(labels.doc_id, 2) == 0), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in got]) > 0.85
    again = quality.quality_scores(docs, labels.selectExpr("doc_id", "nullif(quality, 0) quality"), steps=5)
    assert again.count() == len(TEXTS) and again.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_chunks_cover_every_text():
    raw = np.frombuffer(b"a" * 5000 + b"b" * 3, np.uint8)
    x, to = quality.symbols(raw, np.array([0, 5000, 5000, 5003]))
    places, chunks, counts = quality.chunk_starts(to)
    covered = {int(p) + k for a, b in chunks for p in places[a:b] for k in range(quality.WIDTH)}
    assert set(np.flatnonzero(x != quality.SYMBOLS - 1)) <= covered and len(counts) == 3 and counts.min() >= 1


def test_toxicity(spark, docs, nothing):
    plain, bad = [f"the house number {i} is by the lake {i}" for i in range(60)], [f"you {('idiot', 'moron')[i % 2]} number {i} go away" for i in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(plain + bad)] + [(500, "what an idiot"), (501, "the lake house"), (502, None), (502, ""), (None, "a moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60), 3) for i in range(120)] + [(None, 1, 1), (501, None, 1), (900, 1, 1)], "doc_id long, toxic int, score int")
    got = {(r.doc_id, r.score) for r in toxicity.toxicity_scores(table, labels).collect()}
    by = dict(got)
    assert min(by[500], by[None]) > max(s for i, s in got if i is not None and i < 60) and by[501] < 0.3 and len([i for i, _ in got if i == 502]) == 1
    assert toxicity.toxicity_scores(docs, labels.where("toxic = 0")).where("score <> 0").count() == 0
    assert toxicity.toxicity_scores(nothing, labels).count() == 0


SENTENCES = [(("you {} number{} bad pair go", "what a {} thing {} bad pair", "go {} now {} go bad idea")[i % 3].format(("idiot", "moron", "idiotic", "bridge")[i % 4], i), 1) for i in range(40)]
SENTENCES += [(("the house number {} is by the lake {}", "a bridge{} bad pair and an ideal {} thing", "the lake {} the lake {}")[i % 3].format(i, i % 7), 0) for i in range(50)]


def kneser_ney(texts, learned):
    """Each text's ratio by dictionaries, and sums of the chances of all words given the word before, in ordinary and toxic texts."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode())
    words, pairs = (defaultdict(Counter), defaultdict(lambda: defaultdict(set)))
    for t, y in learned:
        w = split(t)
        words[y].update(w)
        for k in range(1, len(w)):
            pairs[y][w[k - 1], w[k]].add(w[k - 2] if k > 1 else None)
    either = set(words[0]) | set(words[1])
    stems = {w[:6] for w in either}
    kept = {p: [max(len(pairs[y].get(p, ())) - 3, 0) for y in (0, 1)] for p, u in pairs[1].items() if len(u) > 3}

    def alone(w, y):
        n = sum(words[y].values())
        own, below = sum(c for x, c in words[y].items() if x[:6] == w[:6]), {x for x in either if x[:6] == w[:6]}
        p = (len(below) + 1) / (len(either) + len(stems) + 1)
        p = (max(own - 0.75, 0) + 0.75 * len({x[:6] for x in words[y]}) * p) / n
        q = (2 if w in either else 1) / (2 * len(below) + 1) if len(w) > 5 else 1
        if own and len(w) > 5:
            q = (max(words[y][w] - 0.75, 0) + 0.75 * len({x for x in words[y] if x[:6] == w[:6]}) * q) / own
        return p * q

    def after(v, w, y):
        mine = {p: k for p, k in kept.items() if p[0] == v}
        if not mine:
            return alone(w, y)
        whole = [sum(k[c] for k in mine.values()) for c in (0, 1)]
        share = sum(whole) / (words[0][v] + words[1][v])
        k = mine.get((v, w), (0, 0))
        return share * (k[y] + 3 * sum(k) / sum(whole)) / (whole[y] + 3) + (1 - share) * alone(w, y)

    out = []
    for t in texts:
        w = split(t)
        out.append(np.mean([np.log(0.995 + 0.005 * after(v, x, 1) / after(v, x, 0)) for v, x in zip([None, *w], w)]) if w else 0.0)
    unseen = [*(s + b"~~~~~~~~" for s in stems if len(s) > 5), b"~~~~~~~~"]
    return out, [sum(after(v, w, y) for w in [*either, *unseen]) for y in (0, 1) for v in (None, b"bad", b"the", b"go", b"never")], kept


@pytest.mark.parametrize("common", [0, 20])
def test_toxicity_is_kneser_ney(spark, monkeypatch, common):
    """Ratios of all three models against dictionaries, whose chances sum to 1; with rows looked up by shuffle in many parts, and broadcast."""
    monkeypatch.setattr(lookup, "COMMON", common)
    monkeypatch.setattr(lookup, "PART_ROWS", 20)
    monkeypatch.setattr(lookup, "BLOCK_BYTES", 500)
    texts = [t for t, _ in SENTENCES] + ["You IDIOT, go!", "the ideal lake", "idiots", "neverseen bad pair", "bad idea bad pair", "go go go go", ""]
    labelled = spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(SENTENCES)], "text string, toxic int, half int").repartition(5)
    words = toxicity.word_counts(labelled).cache()
    pairs = toxicity.learned_pairs(labelled, words)
    table, default = toxicity.weights(words, pairs)
    assert table.count() == table.select("key").distinct().count()
    for full in (False, True):
        bits = np.full(1 << (toxicity.SIEVE_BITS - 6), -1, np.int64) if full else toxicity.sieve(toxicity.with_slots(pairs.select("pair"), "pair"))
        docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = lookup.summed(docs_, table, 3, np.array(default), toxicity.reader(spark.sparkContext.broadcast(bits))).orderBy("doc_id").collect()
        for m, half in enumerate((None, 0, 1)):
            want, sums, kept = kneser_ney(texts, [x for i, x in enumerate(SENTENCES) if half is None or i % 2 == half])
            assert np.allclose(sums, 1) and (b"bad", b"pair") in kept and any(k[0] for k in kept.values())
            assert np.allclose([r[f"s{m}"] / max(r.n, 1) for r in got], want)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(SENTENCES)], "doc_id long, toxic int")
    ratios = {r.doc_id: r.ratio for r in toxicity.toxicity_ratios(docs_, labels, None, 1000)[0].collect()}
    assert np.allclose([ratios[i] for i in range(len(texts))], kneser_ney(texts, SENTENCES)[0])


def test_pairs_are_counted_by_words_before(spark):
    """A pair after four different words in toxic texts is learned, one that a copied passage repeats is not."""
    texts = [(f"w{i} bad pair", 1, i % 2) for i in range(4)] + [("same bad copy", 1, 0)] * 9 + [(f"w{i} bad copy", 0, 0) for i in range(3)] + [(f"v{i} bad pair", 0, 1) for i in range(6)]
    labelled = spark.createDataFrame(texts, "text string, toxic int, half int").repartition(5)
    got = toxicity.learned_pairs(labelled, toxicity.word_counts(labelled)).drop("pair", "before", "word").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 3, 0, 0)]


def every_pair_by_dictionaries(texts, learned):
    """Each text's ratio with all pairs of both classes, and sums of the chances of all words given the word before, in ordinary and toxic texts."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode())
    words, before = defaultdict(Counter), (defaultdict(set), defaultdict(set))
    for t, y in learned:
        w = split(t)
        words[y].update(w)
        for k in range(1, len(w)):
            before[y][w[k - 1], w[k]].add(w[k - 2] if k > 1 else None)
    count = [{p: len(u) for p, u in before[y].items()} for y in (0, 1)]
    off = [(sum(n == 1 for n in c.values()) + 1) / (sum(n == 1 for n in c.values()) + 2 * sum(n == 2 for n in c.values()) + 2) for c in count]
    either = set(words[0]) | set(words[1])
    stems = {w[:6] for w in either}

    def alone(w, y):
        n = sum(words[y].values())
        own, below = sum(c for x, c in words[y].items() if x[:6] == w[:6]), {x for x in either if x[:6] == w[:6]}
        p = (len(below) + 1) / (len(either) + len(stems) + 1)
        p = (max(own - 0.75, 0) + 0.75 * len({x[:6] for x in words[y]}) * p) / n
        q = (2 if w in either else 1) / (2 * len(below) + 1) if len(w) > 5 else 1
        if own and len(w) > 5:
            q = (max(words[y][w] - 0.75, 0) + 0.75 * len({x for x in words[y] if x[:6] == w[:6]}) * q) / own
        return p * q

    def after(v, w, y):
        mine = [{p[1]: n for p, n in c.items() if p[0] == v} for c in count]
        different = set(mine[0]) | set(mine[1])
        if not different:
            return alone(w, y)
        back = sum(off[c] * len(mine[c]) for c in (0, 1)) / sum(sum(m.values()) for m in mine)
        own = {x: n - off[y] for x, n in mine[y].items()} or dict.fromkeys(different, 1)
        return (1 - back) * own.get(w, 0) / sum(own.values()) + back * (0.25 * (w in different) / len(different) + 0.75 * alone(w, y))

    out = []
    for t in texts:
        w = split(t)
        out.append(np.mean([np.log(0.995 + 0.005 * after(v, x, 1) / after(v, x, 0)) for v, x in zip([None, *w], w)]) if w else 0.0)
    unseen = [*(s + b"~~~~~~~~" for s in stems if len(s) > 5), b"~~~~~~~~"]
    return out, [sum(after(v, w, y) for w in [*either, *unseen]) for y in (0, 1) for v in (None, b"bad", b"the", b"go", b"house", b"idea", b"never")]


@pytest.mark.parametrize("part, block", [(1 << 20, 1 << 19), (40, 30)])
def test_every_pair_is_learned(spark, monkeypatch, part, block):
    """Ratios of all three models against dictionaries, whose chances sum to 1, and those of the query's own path; in small parts, with pairs of frequent words in many of them, too."""
    monkeypatch.setattr(toxicity, "PART_PAIRS", part)
    monkeypatch.setattr(toxicity, "BLOCK_PAIRS", block)
    texts = [t for t, _ in SENTENCES] + ["You IDIOT, go!", "the ideal lake", "idiots", "neverseen bad pair", "bad idea bad pair", "the house go", "go go go go", "lake the bad house", ""]
    labelled = spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(SENTENCES)], "text string, toxic int, half int").repartition(5)
    words = toxicity.word_counts(labelled).cache()
    pairs, many = toxicity.every_pair(labelled, words)
    assert (len(many) > 0) == (part == 40)
    table, stems, root, default = toxicity.word_weights(words)
    table = table.unionByName(toxicity.pair_weights(pairs.cache(), many, toxicity.word_chances(words, stems, root, toxicity.MODELS)))
    assert table.count() == table.select("key").distinct().count()
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bits = toxicity.ored(toxicity.pair_slots(pairs))
    got = lookup.summed(docs_, table, 3, np.array(default), toxicity.reader(spark.sparkContext.broadcast(bits))).orderBy("doc_id").collect()
    for m, half in enumerate((None, 0, 1)):
        want, sums = every_pair_by_dictionaries(texts, [x for i, x in enumerate(SENTENCES) if half is None or i % 2 == half])
        assert np.allclose(sums, 1)
        assert np.allclose([r[f"s{m}"] / max(r.n, 1) for r in got], want, rtol=1e-4, atol=1e-7)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(SENTENCES)], "doc_id long, toxic int")
    ratios = {r.doc_id: r.ratio for r in toxicity.toxicity_ratios(docs_, labels, None, 1000, every=True)[0].collect()}
    assert np.allclose([ratios[i] for i in range(len(texts))], every_pair_by_dictionaries(texts, SENTENCES)[0], rtol=1e-4, atol=1e-7)


@pytest.mark.parametrize("common", [0, 9])
def test_halves_weigh_what_the_sample_asks_for(spark, monkeypatch, common):
    """Pairs that the sample's texts don't have keep one weight of three, the others all; the same with chances of words asked for by shuffle, and broadcast in part."""
    labelled = spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(SENTENCES)], "text string, toxic int, half int").repartition(5)
    words = toxicity.word_counts(labelled).cache()
    pairs, many = toxicity.every_pair(labelled, words)
    _, stems, root, _ = toxicity.word_weights(words)
    chance = toxicity.word_chances(words, stems, root, toxicity.MODELS)
    whole = {r.key: r for r in toxicity.pair_weights(pairs.cache(), many, chance).collect()}
    monkeypatch.setattr(toxicity, "COMMON_WORDS", common)
    bits = toxicity.ored(toxicity.text_slots(labelled.limit(3)))
    got = {r.key: r for r in toxicity.pair_weights(pairs, many, chance, spark.sparkContext.broadcast(bits)).collect()}
    asked = {k for k in got if toxicity.passes(bits, np.array([k]).view(np.uint64))[0]}
    assert got.keys() == whole.keys() and 0 < len(asked) < len(got)
    assert all(got[k] == whole[k] for k in asked)
    assert all((r.w, r.w_0, r.w_1, r.often) == (whole[k].w, None, None, whole[k].often) for k, r in got.items() if k not in asked)


def test_pairs_are_weighed_in_rounds(spark, monkeypatch):
    """Each round stores a share of the pairs, and together they have the rows of one round."""
    monkeypatch.setattr(toxicity, "PART_PAIRS", 40)
    labelled = spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(SENTENCES)], "text string, toxic int, half int").repartition(5)
    words = toxicity.word_counts(labelled).cache()
    pairs, many = toxicity.every_pair(labelled, words)
    _, stems, root, _ = toxicity.word_weights(words)
    chance, shares = toxicity.word_chances(words, stems, root, toxicity.MODELS), []
    monkeypatch.setattr(toxicity, "stored", lambda *a: shares.append(scratch.stored(*a)) or shares[-1])
    want, got = toxicity.pair_weights(pairs.cache(), many, chance), toxicity.pair_weights(pairs, many, chance, None, 3)
    assert rows(got) == rows(want) and len(shares) == 3
    assert all(0 < s.count() < 0.6 * want.count() for s in shares)


@pytest.mark.parametrize("common", [0, 9])
def test_texts_ask_in_rounds(spark, monkeypatch, common):
    """A round's questions are of a share of the texts; all rows come back, with the scores of one round, and no table of weights stays on disk."""
    table = [(i, t) for i, (t, _) in enumerate(SENTENCES)] + [(None, "a moron"), (None, None), (None, "a moron"), (3, "you idiot"), (3, ""), (200, "the lake " * 50)]
    docs_ = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(SENTENCES)], "doc_id long, toxic int")
    folder = Path(scratch.shared_dir(spark).removeprefix("file:")) / f"scriptoria-{spark.sparkContext.applicationId}"
    kept = lambda: {p.name for tag in ("weights", "packed", "pairs", "chances", "words", "stems") for p in folder.glob(tag + "-*")}
    monkeypatch.setattr(lookup, "COMMON", common)
    monkeypatch.setattr(lookup, "PART_ROWS", 20)
    shares = []
    monkeypatch.setattr(lookup, "stored", lambda df, tag: shares.append((tag, scratch.stored(df, tag))) or shares[-1][1])
    before = kept()
    got = toxicity.toxicity_scores(docs_, labels)
    counts = [df.count() for tag, df in shares if tag == "sums"]
    assert kept() == before and len(counts) > 1 and sum(counts) == len(table) and max(counts) < 0.8 * len(table)
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    order = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in df.collect())
    one, more = order(toxicity.toxicity_scores(docs_, labels)), order(got)
    assert [x[:2] for x in one] == [x[:2] for x in more] and np.allclose([x[2] for x in one], [x[2] for x in more])


def test_stored_leaves_no_shuffle(spark):
    """The files of its write's shuffle are gone when it returns, and the table is whole."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*")}
    before = shuffles()
    table = scratch.stored(spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(3, "x"), "table")
    assert not shuffles() - before and table.selectExpr("sum(id)").first()[0] == 499500


def test_few_pairs_count(spark):
    """Of words that both classes have equally often, pairs seen after one or two words in toxic or in ordinary texts alone change the score."""
    bad, good = [f"w{k} {x} {x}" for k in (1, 2) for x in ("alpha", "beta")] + ["idiot one"] * 4, ["w1 alpha beta", "w2 alpha beta", "w1 beta alpha", "w2 beta alpha"] + ["house one"] * 4
    table = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)] + [(100, "alpha alpha"), (101, "alpha beta")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, labels).collect()}
    assert got[100] > got[101] + 0.01


def test_pipeline_learns_every_pair(spark, docs, monkeypatch):
    """Its toxicity stage takes no model of few pairs."""
    monkeypatch.setattr(toxicity, "learned_pairs", None)
    assert 0 < corpus_pipeline.drop_toxic(spark, docs, DATA).count() <= docs.count()


def test_rare_words_keep_their_own_counts(spark, monkeypatch):
    """Two words of one stem, one in toxic texts and one in plain ones, many parts; without broadcast rows, and with some."""
    bad, good = "bridge17", "bridge4711"
    table = spark.createDataFrame([(i, f"{(good, bad)[i % 2]} number{i}") for i in range(80)] + [(100, bad), (101, good)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    got = []
    for common in (0, 8):
        monkeypatch.setattr(lookup, "COMMON", common)
        monkeypatch.setattr(lookup, "PART_ROWS", 20)
        got.append({r.doc_id: r.score for r in toxicity.toxicity_scores(table, labels).collect()})
    assert got[0] == got[1] and got[0][100] > 0.7 > 0.3 > got[0][101]


def test_toxicity_carries_names(docs):
    labels = docs.selectExpr("doc_id", "label toxic")
    with pytest.raises(ValueError):
        toxicity.toxicity_scores(docs, labels, carry=("doc_id", "score"))
    assert toxicity.toxicity_scores(docs, labels, carry=("key", "n_lines")).columns == ["key", "n_lines", "score"]


def test_held_out_toxicity(spark):
    """Over 0.8 F1 at the contract's cut on rows whose labels were not learned from."""
    d = DATA.replace("sf0.001", "sf0.01")
    got = toxicity.op8_query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n = Counter((r.predicted, r.toxic) for r in got.collect())
    assert 2 * n[1, 1] / (2 * n[1, 1] + n[0, 1] + n[1, 0]) > 0.8


@pytest.fixture(scope="module")
def model():
    path = pieces.default_model()
    return pieces.PieceModel(pieces.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("  ▁\n\tabcdethrinE12é中🎉\x00<s>/😀"), max_size=80) | st.text(max_size=40))
def test_pieces_equal_the_library(model, text):
    own, library = model
    ids = library.encode(text)
    assert list(memoryview(own.encode(text)).cast("I")) == ids
    assert [x.decode() for x in own.decode([own.encode(text), b"", own.begin, own.encode(text)])] == [library.decode(ids), "", "", library.decode(ids)]


def test_forgetting_changes_nothing(model, monkeypatch):
    own, library = model
    monkeypatch.setattr(pieces, "PAIRS", 20)
    monkeypatch.setattr(pieces, "MEMORY", 3)
    own.encoded.forget()
    for text in ("the quick brown fox jumps over the lazy dog " * 3, "über straße naïve 中文字 x\u0301", LONG[:3000]):
        assert list(memoryview(own.encode(text)).cast("I")) == library.encode(text)
    assert len(own.encoded) <= 3 and len(own.encoded.older) <= 3 and own.tested <= 20
    assert sum(map(len, own.neighbours)) <= 20


def test_words_and_marks_are_encoded_apart(model, monkeypatch):
    own, library = model
    asked = []
    monkeypatch.setattr(own, "encoded", pieces.Memory(lambda x: asked.append(x) or own.encode_segment(x)))
    words = ["cat", "Haus", "über", "theaontion", "naive"]
    text = " ".join(f"{a},\n{b}" for a in words for b in words)
    assert list(memoryview(own.encode(text)).cast("I")) == library.encode(text)
    assert len(asked) == len(set(asked)) <= 2 * len(words) + 2


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab ▁é", min_size=2, max_size=6).map(lambda p: p.replace(" ", "▁")), st.integers(-4, 0), max_size=14), st.sets(st.sampled_from("ab▁é"), min_size=1), st.lists(st.text("ab ▁éc", max_size=24), min_size=1, max_size=5))
def test_any_vocabulary_is_merged_alike(scores, single, texts):
    """Equal scores, pieces of worse-scored parts, pieces that cross words, characters without a piece."""
    scores = scores | dict.fromkeys(sorted(single), -9)
    vocabulary = [("<s>", 0.0, "mark"), ("</s>", 0.0, "mark"), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256)), *((p, float(s), "text") for p, s in scores.items())]
    ids, own = {p: i for i, (p, _, _) in enumerate(vocabulary)}, pieces.PieceModel(vocabulary)

    def merged(text):
        parts = list(text)
        while found := [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]:
            i = min(found)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        return parts

    for text, got in zip(texts, own.encode_all(texts), strict=True):
        parts = merged(("▁" + text).replace(" ", "▁")) if text else []
        assert list(memoryview(got).cast("I")) == [i for p in parts for i in ([ids[p]] if p in ids else [ids[f"<0x{b:02X}>"] for b in p.encode()])]
    for a in scores:
        for b in scores:
            if merged(a) == [a] and merged(b) == [b]:
                assert own.compatible(a, b) == (merged(a + b) == [a, b])


def test_encoding(docs, nothing, model):
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in pieces.encode_texts(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        ids = model[1].encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), struct.pack(f"<{len(ids)}I", *ids), model[1].decode(ids)] += 1
    assert got == want and pieces.encode_texts(nothing).count() == 0


def test_pipeline_stages(spark, docs):
    """Each stage's rows against what its operator's result says about its own input."""
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    names = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(spark, now, DATA)
        after = now.collect()
        if name != "encoding":
            assert now.columns == names
        texts = {r.doc_id: r.text for r in before}
        if name == "toxicity":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            scores = toxicity.toxicity_scores(spark.createDataFrame(before), labels, toxicity.crc_left(labels.doc_id, 3) == 1).collect()
            assert {r.doc_id for r in after} == {r.doc_id for r in scores if r.score < 0.7}
        if name == "line dedup":
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "near dedup":
            sets = {i: shingles(t) for i, t in texts.items()}
            stay = {r.doc_id for r in after}
            assert all(any(100 * len(s & sets[j]) >= 75 * len(s | sets[j]) for j in sets if j < i) for i, s in sets.items() if i not in stay)
            assert not any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i, j in combinations(sorted(stay), 2) if sets[i])
        if name == "decontamination":
            find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
            grams = {tuple(w[k : k + min(10, len(w))]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [find(r.text)] for k in range(max(1, len(w) - 9))}
            clean = {i for i, t in texts.items() if not any(tuple(w[k : k + 10]) in grams for w in [find(t)] for k in range(len(w)))}
            assert {r.doc_id for r in after} == clean
        if name == "encoding":
            assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in after) and len(after) == len(before)


def test_pipeline_on_awkward_rows(spark, docs):
    rows_ = docs
    for _, stage in corpus_pipeline.STAGES:
        rows_ = stage(spark, rows_, DATA)
    assert rows_.count() > 5


def phrases_of(text):
    """Phrases of an LZ78 parse, as texts."""
    known, now = set(), ""
    for c in text:
        now += c
        if now not in known:
            known.add(now)
            now = ""
    return known


@settings(max_examples=100, deadline=None)
@given(st.text("abc é🎉", max_size=200), st.text("abc é🎉", max_size=200))
def test_fingerprints_are_those_of_phrase_sets(a, b):
    """Fewer phrases than a fingerprint holds: likeness is that of the sets themselves, and a parse that branches gives the same."""
    def mark(*texts):
        p = lempel_ziv.Parse()
        for t in texts:
            p = p.copy()
            p.more(lempel_ziv.code_points(t))
        return p.least()

    x, y = phrases_of(a), phrases_of(b)
    assert len(mark(a)) == len(x) and (mark(a, b) == mark(a + b)).all()
    assert lempel_ziv.likeness(mark(a), mark(b)) == (len(x & y) / len(x | y) if x | y else 1.0)


def test_whole_table_of_fingerprints(spark):
    """Every row against the order of rows, from the last to the first, with repeated rows, equal ids and null ids, over many ranges."""
    texts = [(i, f"text {i} " * (i % 7)) for i in range(40)] + [(5, "other five"), (5, "other five"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = lempel_ziv.fingerprints(df).collect()
    order = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("text").alias("d")).orderBy(F.col("doc_id").desc_nulls_last(), F.col("d").desc_nulls_last()).collect()
    want = Counter()
    for r, after in zip(order, [*order[1:], order[0]]):
        third = len(r.t) // 3
        edited = r.t[: len(r.t) - third] + after.t[:third]
        x, y, z = phrases_of(r.t), phrases_of(edited), phrases_of(after.t)
        want[r.doc_id, len(r.t), hashlib.sha256(edited.encode()).hexdigest(), *(round(len(x & q) / len(x | q) if x | q else 1.0, 9) for q in (y, z))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def network(texts, p):
    """Scores by the definition: each filter's largest response in each chunk, chunks' mean and largest, one logistic unit."""
    out = []
    for t in texts:
        echo = [i >= quality.ECHO and any(t[i : i + 4].ljust(4, b"\0") == t[j : j + 4].ljust(4, b"\0") for j in range(i - quality.ECHO, i - 1)) for i in range(len(t))]
        x = [quality.SYMBOLS - 1] * quality.WIDTH + [b + 256 * e for b, e in zip(t, echo)] + [quality.SYMBOLS - 1] * quality.WIDTH
        z = [sum(p["filters"][k][x[i + k]].astype(float) for k in range(quality.WIDTH)) + p["bias"] for i in range(0, len(x) - quality.WIDTH + 1, quality.STRIDE)]
        chunks, at = [], 0
        while True:
            chunks.append(np.maximum(np.max(z[at : at + quality.CHUNK], axis=0), 0))
            at += quality.CHUNK - quality.OVERLAP
            if at + quality.OVERLAP >= len(z):
                break
        s = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
        out.append(1 / (1 + np.exp(-(s @ p["w"] + p["b"][0]))))
    return out


def test_network_is_its_definition():
    texts = [b"", b"a", b"the cat sat on the mat " * 30, bytes(range(256)) * 3, "é🎉".encode() * 200]
    rng = np.random.default_rng(1)
    p = {"filters": rng.normal(0, 0.3, (quality.WIDTH, quality.SYMBOLS, quality.FILTERS)).astype(np.float32), "bias": rng.normal(0, 0.1, quality.FILTERS).astype(np.float32), "w": rng.normal(0, 0.3, 2 * quality.FILTERS).astype(np.float32), "b": np.array([0.1], np.float32)}
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    assert np.allclose(quality.scores(np.frombuffer(b"".join(texts), np.uint8), off, p), network(texts, p), atol=1e-4)


def test_training_lowers_the_loss():
    texts, labels = [b"good words here %d" % i for i in range(20)] + [b"%%%% $$$$ &&&& %d" % i for i in range(20)], np.repeat([1.0, 0.0], 20).astype(np.float32)
    loss = []
    for steps in (1, 60):
        p = network(texts, quality.train(texts, labels, steps))
        loss.append(-np.mean(np.log(np.where(labels == 1, p, 1 - np.array(p)) + 1e-9)))
    assert loss[1] < 0.1 < loss[0]


CONTRACTS = {
    "op1_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_lempel_ziv_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_byte_network_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_kneser_ney_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_repeated_spans": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_prefix_table_pieces": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_keep_their_contracts(spark, model, name):
    got = queries.QUERIES[name](spark, DATA)
    types = dict(got.dtypes)
    for column in CONTRACTS[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows_ = got.collect()
    assert sorted(r.doc_id for r in rows_) == sorted(table)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in rows_:
        t = table[r.doc_id]
        if name.startswith("op1_"):
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) and 0 <= r.shard < 16
        if name.startswith(("op6", "op8")):
            n, left, cut = (5, 0, 0.3) if name.startswith("op6") else (3, 1, 0.7)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == left) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1
        if name.startswith("op10"):
            ids = model[1].encode(t, add_bos=True, add_eos=True)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(model[1].decode(ids).encode()))


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_an_empty_table(spark, nothing, at):
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, nothing, DATA).count() == 0


HEAPS = """
import re, time
from pathlib import Path
import psutil
from pyspark.sql import SparkSession
from scriptoria.llm.scratch import collected
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
heaps = [p.pid for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
held = lambda: [int(re.search(r"Anonymous:\\s+(\\d+)", Path(f"/proc/{p}/smaps_rollup").read_text())[1]) >> 10 for p in heaps]
spark.range(0, 8_000_000, 1, 2).selectExpr("id % 1000003 k", "repeat(cast(id as string), 9) v").groupBy("k").agg({"v": "max"}).write.format("noop").mode("overwrite").save()
before = held()
collected(spark)
for _ in range(20):
    if all(b < a - 100 for a, b in zip(before, held())):
        break
    time.sleep(0.5)
print(len(heaps), before, held())
assert len(heaps) == 2 and all(b < a - 100 for a, b in zip(before, held()))
"""


def test_executors_give_their_heaps_back(tmp_path):
    import pyspark

    (tmp_path / "home/work").mkdir(parents=True)  # executors work there
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(Path(corpus_pipeline.__file__).parent)}
    done = subprocess.run([sys.executable, "-c", HEAPS], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stdout + done.stderr[-2000:]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_begin_with_collected_heaps(spark, nothing, monkeypatch, at):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "collected", seen.append)
    corpus_pipeline.STAGES[at][1](spark, nothing, DATA)
    assert seen == [spark]
