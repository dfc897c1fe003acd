"""Toxicity by class-conditional Kneser-Ney models of word pairs, words and stems, with backoff counts that both classes share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.kernels import LOWER, Words, give_back, mix, released, slices, text_bytes
from scriptoria.llm.lookup import OWN_BITS, common_rows, places, squeezed, summed, unsqueezed
from scriptoria.llm.scratch import bound_batches, collected, drop, stored, tidy

#: A word that is rare is learned from the others with its first so many bytes.
STEM = 6
#: Absolute discounts of words, stems and shared counts, and of the pairs that learned_pairs() keeps, those that follow more than three different words in toxic texts.
DISCOUNT, PAIR_DISCOUNT = 0.75, 3
#: Share of a toxic text's words that the toxic model draws; the others are drawn by the ordinary one.
SHARE = 0.005
#: Labelled rows at most to which slope and cut of the score are fitted; counts are taken over all of them.
FIT_ROWS = 20_000
#: The score at the cut.
AT_CUT = 0.7
#: Label rows up to which they are broadcast to the documents; beyond, both sides are shuffled.
MAX_BROADCAST = 500_000
#: Bits of a sieve, whatever the corpus; a full one lets all keys through and changes no result.
SIEVE_BITS = 26
#: Bits of a range of a sieve's slots.
RANGE_BITS = 6
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
COUNTS = ["toxic_0", "plain_0", "toxic_1", "plain_1"]
#: Occurrences of pairs that a part has, about, and that a task holds before it packs them. It changes no result.
PART_PAIRS, BLOCK_PAIRS = 1 << 20, 1 << 19
#: Words at most whose pairs are dealt one by one, those with more occurrences than an eighth of a part; all pairs after another word lie in one part.
MANY = 1 << 12
#: Words at most whose chances are broadcast to the parts of the pairs, the most frequent ones; parts ask for the others. It changes no result.
COMMON_WORDS = 1 << 16
#: Rounds in which parts of the pairs are weighed, and in which texts ask for weights; each has its share of the shuffled bytes on disk. It changes no result.
ROUNDS = 2
#: The models, of both halves of the labelled rows and of each: their columns of toxic and of ordinary counts.
MODELS = ("", "_0", "_1")
#: How many pairs have a count of 1 and of 2, for the six counts of every_pair().
FEW = [f + c + m for m in MODELS for c in ("toxic", "plain") for f in ("once_", "twice_")]


class Terms:
    """Keys of the words of a slice, of which all but OWN_BITS are those of the word's stem, and of the pairs that they end; which words open a text, and which are shorter than a stem."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.words = w = Words(LOWER[raw], off, NOT_WORD)
        stem, word = w.hashes(STEM, 1 << 40)
        own = np.uint64((1 << OWN_BITS) - 1)
        self.word = (mix(stem + np.uint64(1)) & ~own) | np.maximum(mix(word + np.uint64(2)) & own, np.uint64(1))
        self.brief = w.end - w.start < STEM
        self.opens = np.zeros(len(word), bool)
        self.opens[w.first[:-1][w.per_doc > 0]] = True
        self.before = np.append(np.zeros(1, np.uint64), self.word[:-1])[: len(word)]
        self.pair = mix(self.before * np.uint64(0x9E3779B97F4A7C15) ^ mix(self.word))

    def earlier(self) -> np.ndarray:
        """27 bits of the word before each pair; 0 at a text's start."""
        out = np.zeros(len(self.word), np.int64)
        out[2:] = (mix(self.word[:-2]) >> np.uint64(37)).astype(np.int64)
        out[1:][self.opens[:-1]] = 0
        return out


def slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def sieve(slots: DataFrame) -> np.ndarray:
    """Bits by slot, of the column slot: at most 2 ** SIEVE_BITS / 8 bytes, however many rows."""
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = slot(keys)
    return bits[at >> 6] >> (at & 63) & 1 == 1


def kinds(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's place in COUNTS."""
    return batch.column("half").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + (batch.column("toxic").to_numpy(zero_copy_only=False) != 1)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(key, brief, slot, toxic_0, plain_0, toxic_1, plain_1, toxic, plain): every word's count by class and half, of ``labelled`` (text, toxic, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            kind = kinds(batch)
            for i, j in slices(off):
                t = Terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                one, at, where = np.unique(t.word, return_index=True, return_inverse=True)
                n = np.bincount(where * 4 + np.repeat(kind[i:j], t.words.per_doc), minlength=4 * len(one)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(t.brief[at]), *[pa.array(x) for x in n.T.copy()]], names=["key", "brief", *COUNTS])

    part = labelled.select("text", "toxic", "half").mapInArrow(released(run), "key long, brief boolean, " + ", ".join(f"{c} long" for c in COUNTS))
    whole = part.groupBy("key").agg(F.first("brief").alias("brief"), *[F.sum(c).alias(c) for c in COUNTS])
    return whole.withColumn("toxic", F.col("toxic_0") + F.col("toxic_1")).withColumn("plain", F.col("plain_0") + F.col("plain_1"))


def pair_counts(labelled: DataFrame, sieved: Broadcast, of: str, least: int) -> DataFrame:
    """(before, word, n, n_0, n_1): after how many different words each pair occurs in ``labelled`` (text, half), and in each half; more than ``least``.

    ``sieved`` lets all pairs through that are wanted: by their keys if ``of`` is "pair", by those of their two words if it is "word". Rows are sorted
    and worked through as a stream; one pair's different words before it are held at a time.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            half = batch.column("half").to_numpy(zero_copy_only=False).astype(np.int64)
            found: list[tuple] = []
            for i, j in slices(off):
                t = Terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                take = passes(sieved.value, getattr(t, of)) & ~t.opens
                if of == "word":
                    take[1:] &= passes(sieved.value, t.word[:-1])
                tail = t.earlier() << 2 | 1 << np.repeat(half[i:j], t.words.per_doc)
                found.append((t.before[take], t.word[take], tail[take]))
            v, w, tail = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.uint64, np.uint64, np.int64), zip(*found) if found else ((), (), ())))
            by = np.lexsort((tail, w, v))
            v, w, tail = v[by], w[by], tail[by]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (tail[1:] != tail[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(v[new].view(np.int64)), pa.array(w[new].view(np.int64)), pa.array(tail[new].astype(np.int32))], names=["before", "word", "tail"])

    def counted(v: np.ndarray, w: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
        early = tail >> 2
        same = (v[1:] == v[:-1]) & (w[1:] == w[:-1])
        new = np.flatnonzero(np.append(True, ~same | (early[1:] != early[:-1])))
        mask, v, w = np.bitwise_or.reduceat(tail & 3, new), v[new], w[new]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        n = [np.add.reduceat((mask & bits > 0).astype(np.int64), first) for bits in (3, 1, 2)]
        keep = n[0] > least
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (v[first], w[first], *n)], names=["before", "word", "n", "n_0", "n_1"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.append(h, batch.column(c).to_numpy()) for h, c in zip(held, ("before", "word", "tail"))]
            if not len(held[0]):
                continue
            last = int(np.flatnonzero(np.append(True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])))[-1])
            if last:
                yield counted(*[h[:last] for h in held])
            tail = np.unique(held[2][last:])
            held = [held[0][last : last + len(tail)], held[1][last : last + len(tail)], tail]
        if len(held[0]):
            yield counted(*held)

    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = labelled.select("text", "half").mapInArrow(released(emit), "before long, word long, tail int")
    return events.repartition(n, "before", "word").sortWithinPartitions("before", "word", "tail").mapInArrow(released(count), "before long, word long, n long, n_0 long, n_1 long")


def with_slots(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with the column slot of the long ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slot(batch.column(key).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "slot"])

    return keys.mapInArrow(released(run), keys.select("*").schema.add("slot", "long"))


def with_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (before, word, others) with the pair's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
            key = mix(v * np.uint64(0x9E3779B97F4A7C15) ^ mix(w))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=[*batch.schema.names, "pair"])

    return pairs.mapInArrow(released(run), pairs.select("*").schema.add("pair", "long"))


def stem_key(key: str) -> Column:
    return F.shiftleft(F.shiftright(key, OWN_BITS), OWN_BITS)


def stem_counts(words: DataFrame) -> DataFrame:
    """(stem, and for each model m: toxic+m and plain+m, occurrences; kt+m, kp+m and k+m, different words in toxic texts, in ordinary ones and in either)."""
    out = []
    for m in MODELS:
        t, p = F.col("toxic" + m), F.col("plain" + m)
        out += [F.sum(t).alias("toxic" + m), F.sum(p).alias("plain" + m), F.count_if(t > 0).alias("kt" + m), F.count_if(p > 0).alias("kp" + m), F.count_if(t + p > 0).alias("k" + m)]
    return words.groupBy(stem_key("key").alias("stem")).agg(*out)


def root_counts(stems: DataFrame) -> dict[str, float]:
    """The same of all words, and s+m: different stems in either; kt and kp count stems here."""
    out = []
    for m in MODELS:
        zero = F.lit(0).cast("long")
        out += [F.coalesce(F.sum("toxic" + m), zero).alias("toxic" + m), F.coalesce(F.sum("plain" + m), zero).alias("plain" + m), F.count_if(F.col("toxic" + m) > 0).alias("kt" + m), F.count_if(F.col("plain" + m) > 0).alias("kp" + m)]
        out += [F.coalesce(F.sum("k" + m), zero).alias("k" + m), F.count_if(F.col("k" + m) > 0).alias("s" + m)]
    return {k: float(v) for k, v in stems.agg(*out).first().asDict().items()}


def chances(m: str, root: dict[str, float], word: tuple[Column, Column, Column], stem: dict[str, Column]) -> list[Column]:
    """P(word) in toxic and in ordinary texts of model ``m``, from the word's occurrences in each and whether it is shorter than a stem, and its stem's counts: interpolated Kneser-Ney.

    P(stem) P(word | stem), each of which is (count - DISCOUNT) / count above and, for what the discounts leave, the share of the
    different words of both classes: (different words + 1) / (different words above + continuations above + 1), where the one more is for what was never seen. So the
    chances of all words and of one never seen below each stem, and one below none, sum to 1. A class that never has the stem takes the share itself.
    Words shorter than a stem are the only ones of theirs.
    """
    out = []
    first = (stem["k" + m] + 1) / F.lit(root["k" + m] + root["s" + m] + 1)
    then = F.when(word[0] + word[1] > 0, 2.0).otherwise(1.0) / (2 * stem["k" + m] + 1)
    for c, kinds_, own in (("toxic", "kt", word[0]), ("plain", "kp", word[1])):
        above, n = root[c + m], stem[c + m]
        p = (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * root[kinds_ + m] * first) / F.lit(above) if above else first
        q = F.when(n > 0, (F.greatest(own - DISCOUNT, F.lit(0.0)) + DISCOUNT * stem[kinds_ + m] * then) / n).otherwise(then)
        out.append(p * F.when(word[2], 1.0).otherwise(q))
    return out


def ratio(toxic: Column, plain: Column) -> Column:
    """Log of how much likelier a toxic text, SHARE of whose words the toxic model draws, has a word than an ordinary one."""
    return F.log(F.lit(1 - SHARE) + SHARE * toxic / plain)


def word_chances(words: DataFrame, stems: DataFrame, root: dict[str, float], models: tuple[str, ...]) -> DataFrame:
    """(key, often, and for each model m: toxic+m and plain+m, the chances of each word)."""
    at = {c: F.col(f"s.{c}") for c in stems.columns}
    named = words.alias("w").join(stems.alias("s"), stem_key("w.key") == F.col("s.stem"))
    out = []
    for m in models:
        both = chances(m, root, (F.col(f"w.toxic{m}"), F.col(f"w.plain{m}"), F.col("w.brief")), at)
        out += [p.alias(c + m) for c, p in zip(("toxic", "plain"), both)]
    return named.select("w.key", (F.col("w.toxic") + F.col("w.plain")).alias("often"), *out)


def word_weights(words: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float], list[float]]:
    """(key, w, w_0, w_1, often) for each model: the ratio of each word; that of a word never seen, by its stem. The counts of stems and of all; and the ratio of a word whose stem is never seen."""
    stems = stored(stem_counts(words), "stems")
    root = root_counts(stems)
    own = word_chances(words, stems, root, MODELS)
    own = own.select("key", *[ratio(F.col("toxic" + m), F.col("plain" + m)).alias("w" + m) for m in MODELS], "often")
    nothing = (F.lit(0), F.lit(0), F.lit(False))
    alone = {c: F.col(c) for c in stems.columns}
    unseen = stems.select(F.col("stem").alias("key"), *[ratio(*chances(m, root, nothing, alone)).alias("w" + m) for m in MODELS], F.lit(0).cast("long").alias("often"))
    default = [float(np.log(1 - SHARE + SHARE * _unknown(root, m))) for m in MODELS]
    return own.unionByName(unseen), stems, root, default


def weights(words: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[float]]:
    """The rows of word_weights(), and of each of ``pairs``
    (pair, before, word, and x+m, y+m: what a pair keeps after the discount in toxic and in ordinary texts), what it adds to its word's. And the ratio of a word whose stem is never seen.

    P(word | word before) = m q + (1 - m) P(word). m is the share of the word before's occurrences, in both classes, that its pairs keep
    after the discount, and so is shared; q is the pair's share of what they keep in a class, with the share in both as PAIR_DISCOUNT further counts. Where there is no pair, m falls out of the ratio.
    """
    table, stems, root, default = word_weights(words)
    kept = pairs.groupBy("before").agg(*[F.sum(x + m).alias(x.upper() + "s" + m) for m in MODELS for x in "xy"])
    seen = words.select(F.col("key").alias("before"), *[(F.col("toxic" + m) + F.col("plain" + m)).alias("seen" + m) for m in MODELS])
    found = pairs.join(kept, "before").join(seen, "before").alias("p").join(word_chances(words, stems, root, MODELS).alias("c"), F.col("p.word") == F.col("c.key"))
    extra = []
    for m in MODELS:
        x, y, xs, ys, n = (F.col(c + m) for c in ("p.x", "p.y", "p.Xs", "p.Ys", "p.seen"))
        share, both = (xs + ys) / F.greatest(n, F.lit(1)), F.greatest(xs + ys, F.lit(1))
        toxic, plain = F.col("c.toxic" + m), F.col("c.plain" + m)
        mixed = [share * (own_ + PAIR_DISCOUNT * (x + y) / both) / (all_ + PAIR_DISCOUNT) + (1 - share) * p for own_, all_, p in ((x, xs, toxic), (y, ys, plain))]
        extra.append(F.when(x > 0, ratio(*mixed) - ratio(toxic, plain)).otherwise(0.0).alias("w" + m))
    after = found.select(F.col("p.pair").alias("key"), *extra, (F.col("p.x") + F.col("p.y")).alias("often"))
    return table.unionByName(after), default


def _unknown(root: dict[str, float], m: str) -> float:
    p = [DISCOUNT * root[k + m] / root[c + m] if root[c + m] else 1.0 for c, k in (("toxic", "kt"), ("plain", "kp"))]
    return p[0] / p[1]


def learned_pairs(labelled: DataFrame, words: DataFrame) -> DataFrame:
    """(pair, before, word, x, x_0, x_1, y, y_0, y_1) of the pairs that toxic texts have after more than PAIR_DISCOUNT different words: those numbers less the
    discount in toxic (x) and ordinary texts (y), 0 where toxic ones keep nothing.

    Toxic texts are counted first, for pairs of words that they have that often; of ordinary texts, the larger class, pairs found there alone are counted.
    """
    spark = labelled.sparkSession
    often = spark.sparkContext.broadcast(sieve(with_slots(words.where(f"toxic > {PAIR_DISCOUNT}").select("key"), "key")))
    toxic = stored(with_pairs(pair_counts(labelled.where("toxic = 1"), often, "word", PAIR_DISCOUNT)), "pairs")
    wanted = spark.sparkContext.broadcast(sieve(with_slots(toxic.select("pair"), "pair")))
    plain = pair_counts(labelled.where("toxic <> 1"), wanted, "pair", PAIR_DISCOUNT)
    plain = plain.select("before", "word", *[F.col("n" + m).alias("o" + m) for m in MODELS])
    keeps = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0)) - PAIR_DISCOUNT, F.lit(0)).cast("long")
    out = toxic.join(plain, ["before", "word"], "left")
    out = out.select("pair", "before", "word", *[keeps("n" + m).alias("x" + m) for m in MODELS], *[F.when(F.col("n" + m) > PAIR_DISCOUNT, keeps("o" + m)).otherwise(0).alias("y" + m) for m in MODELS])
    return stored(out, "learned")


def merged(v: np.ndarray, w: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (v, w) and what is before them (``tail`` without its last four bits), sorted and each once, with the bits that any of them has."""
    by = np.lexsort((tail, w, v))
    v, w, tail = v[by], w[by], tail[by]
    new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (tail[1:] >> 4 != tail[:-1] >> 4))[: len(v)])
    return v[new], w[new], np.bitwise_or.reduceat(tail, new) if len(new) else tail


def packed_pairs(v: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs sorted by v and w, and whole numbers from 0 on beside."""
    new = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    one, back = np.unique(w, return_inverse=True)
    return squeezed(np.diff(v[new], prepend=np.uint64(0)), np.diff(np.append(new, len(v))) - 1, np.diff(one, prepend=np.uint64(0)), back, *more)


def unpacked_pairs(data: bytes, more: int) -> list[np.ndarray]:
    v, times, one, back, *rest = unsqueezed(data, 4 + more)
    v = np.repeat(np.cumsum(v, dtype=np.uint64), times.astype(np.int64) + 1)
    return [v, np.cumsum(one, dtype=np.uint64)[back.astype(np.int64)], *[x.astype(np.int64) for x in rest]]


def every_pair(labelled: DataFrame, words: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """All pairs of ``labelled`` (text, toxic, half) in parts: (part, data; once+c and twice+c, how many pairs have a count of 1 and of 2), and the words whose pairs are in more than one part.

    ``data`` packs pairs with six counts: after how many different words each occurs in toxic and in ordinary texts, for each of MODELS.
    """
    spark = labelled.sparkSession
    n = F.col("toxic") + F.col("plain")
    total = words.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-total // PART_PAIRS))
    many = words.where(n > max(PART_PAIRS // 8, total // MANY)).select("key").toArrow().column("key").to_numpy()
    many = np.sort(many.astype(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(many)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            v, w, tail = merged(*[np.concatenate(x) for x in zip(*found)])
            found.clear()
            one, back = np.unique(v, return_inverse=True)
            whole = np.where(places(shared.value, one)[1][back], v * np.uint64(0x9E3779B97F4A7C15) ^ mix(w), v)
            part = (mix(whole + np.uint64(3)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            have = np.flatnonzero(np.diff(cuts)).tolist()
            data = [packed_pairs(*[x[by[cuts[p] : cuts[p + 1]]] for x in (v, w, tail)]) for p in have]
            return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            kind = kinds(batch)
            for i, j in slices(off):
                t = Terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                tail = t.earlier() << 4 | 1 << np.repeat(kind[i:j], t.words.per_doc)
                found.append(tuple(x[~t.opens] for x in (t.before, t.word, tail)))
                if sum(len(f[0]) for f in found) >= BLOCK_PAIRS:
                    yield out()
        if found:
            yield out()

    def counted(part: int, v: np.ndarray, w: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))[: len(v)])
        n = [np.add.reduceat((tail & bits > 0).astype(np.int64), new) if len(new) else tail for bits in (5, 10, 1, 2, 4, 8)]  # the bits of kinds()
        few = [pa.array([int((x == k).sum())], pa.int64()) for x in n for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed_pairs(v[new], w[new], *n)], pa.binary()), *few], names=["part", "data", *FEW])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                if p != now:
                    if held:
                        yield counted(now, *merged(*[np.concatenate(x) for x in zip(*held)]))
                    now, held, most = p, [], 2 * PART_PAIRS
                held.append(tuple(unpacked_pairs(data.as_py(), 1)))
                if sum(len(h[0]) for h in held) > most:
                    held = [merged(*[np.concatenate(x) for x in zip(*held)])]
                    most = max(most, 2 * len(held[0][0]))
        if held:
            yield counted(now, *merged(*[np.concatenate(x) for x in zip(*held)]))

    dealt = labelled.select("text", "toxic", "half").mapInArrow(released(emit), "part int, data binary").repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(count), "part int, data binary, " + ", ".join(f"{f} long" for f in FEW)), many


def discounts(pairs: DataFrame) -> list[float]:
    """Of the six counts: pairs found once / (once + 2 twice), in each with one more of both, so that it is above 0 and below 1."""
    few = pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FEW]).first()
    return [(few[k] + 1) / (few[k] + 2 * few[k + 1] + 2) for k in range(0, len(FEW), 2)]


def starts(v: np.ndarray, n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words ``v`` before pairs, each pair's, and of each word for each model: counts of its pairs in toxic and in ordinary texts, and different ones in these and in either."""
    one, back = np.unique(v, return_inverse=True)
    out = []
    for t, p in zip(n[::2], n[1::2]):
        out += [np.bincount(back, x, len(one)) for x in (t, p, t > 0, p > 0, t + p > 0)]
    return one, back, np.stack(out, axis=1).astype(np.int64)


def divided_starts(pairs: DataFrame, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For starts(): the numbers of the words ``many``, over all parts."""
    if not len(many):
        return many, np.zeros((0, 5 * len(MODELS)), np.int64)
    shared = pairs.sparkSession.sparkContext.broadcast(many)
    names = [f"c{k}" for k in range(5 * len(MODELS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                v, _, *n = unpacked_pairs(data.as_py(), 6)
                one, _, have = starts(v, n)
                mine = places(shared.value, one)[1]
                yield pa.RecordBatch.from_arrays([pa.array(one[mine].view(np.int64)), *[pa.array(x) for x in have[mine].T.copy()]], names=["key", *names])

    out = pairs.select("data").mapInArrow(released(run), "key long, " + ", ".join(f"{c} long" for c in names)).groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    key = out.column("key").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(key)
    return key[by], np.stack([out.column(c).to_numpy() for c in names], axis=1)[by]


def pair_weights(pairs: DataFrame, many: np.ndarray, chance: DataFrame, halved: Broadcast | None = None, rounds: int = 0) -> DataFrame:
    """(key, w, w_0, w_1, often) of all pairs of every_pair(): what a pair adds to the ratio of its word, whose chances ``chance`` has.

    P(word | word before) = (1 - b) q + b ((1 - DISCOUNT) / k + DISCOUNT P(word)): interpolated Kneser-Ney. q is the pair's share of what the pairs after the word before keep in a class
    beyond its discount; b is the share that they lose in both classes, and k counts the different ones of both. A pair never seen after a word has neither q nor 1 / k, so b falls out of its ratio.
    A class that never has the word before takes the share 1 / k as q. The chances of all words after one sum to 1. A part of the pairs gets the chances of its words by
    shuffle, but for the most frequent ones. w_0 and w_1 are null of pairs that ``halved`` doesn't let through, if it is given. With ``rounds``, the parts are dealt to them and each round's rows are stored before the next.
    """
    spark = pairs.sparkSession
    off, divided = discounts(pairs), spark.sparkContext.broadcast(divided_starts(pairs, many))
    names = [c + m for m in MODELS for c in ("toxic", "plain")]
    chance = chance.select("key", *[F.col(c).cast("float").alias(c) for c in names], "often")
    common = spark.sparkContext.broadcast(common_rows(chance, len(names), COMMON_WORDS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                w = np.unique(unpacked_pairs(data.as_py(), 6)[1])
                w = w[~places(common.value[0], w)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), p, np.int32)), pa.array(w.view(np.int64))], names=["part", "word"])

    def weigh(part: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        key = np.append(common.value[0], words.column("word").to_numpy().astype(np.int64).view(np.uint64))
        by = np.argsort(key)
        key, alone = key[by], [np.append(x, words.column(c).to_numpy().astype(float))[by] for c, x in zip(names, common.value[1].T)]
        for data in part.column("data"):
            v, w, *n = unpacked_pairs(data.as_py(), 6)
            one, back, have = starts(v, n)
            spot, mine = places(divided.value[0], one)
            have[mine] = divided.value[1][spot[mine]]
            at = np.searchsorted(key, w)
            more = []
            for k in range(len(MODELS)):
                all_, kinds_, either = have[:, 5 * k : 5 * k + 2], have[:, 5 * k + 2 : 5 * k + 4], np.maximum(have[:, 5 * k + 4], 1)
                lost = kinds_ * np.array(off[2 * k : 2 * k + 2])
                b, whole = (lost.sum(1) / np.maximum(all_.sum(1), 1))[back], either[back]
                p = [x[at] for x in alone[2 * k : 2 * k + 2]]
                after = []
                for c in (0, 1):
                    keeps = (all_ - lost)[:, c][back]
                    q = np.where(keeps > 0, np.maximum(n[2 * k + c] - off[2 * k + c], 0) / np.where(keeps > 0, keeps, 1), 1 / whole)
                    after.append((1 - b) * q + b * ((1 - DISCOUNT) / whole + DISCOUNT * p[c]))
                gain = np.log((1 - SHARE + SHARE * after[0] / after[1]) / (1 - SHARE + SHARE * p[0] / p[1]))
                more.append(np.where(n[2 * k] + n[2 * k + 1] > 0, gain, 0).astype(np.float32))
            pair = mix(v * np.uint64(0x9E3779B97F4A7C15) ^ mix(w))
            none = None if halved is None else ~passes(halved.value, pair)
            out.append(pa.table([pa.array(pair.view(np.int64)), pa.array(more[0]), *[pa.array(x, mask=none) for x in more[1:]], pa.array(n[0] + n[1])], names=["key", *["w" + m for m in MODELS], "often"]))
        give_back()
        return pa.concat_tables(out)

    def weighed(some: DataFrame) -> DataFrame:
        asked = some.mapInArrow(released(ask), "part int, word long").join(chance, F.col("word") == F.col("key")).select("part", "word", *names)
        return some.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(weigh, "key long, " + ", ".join(f"w{m} float" for m in MODELS) + ", often long")

    pairs = pairs.select("part", "data")
    if not rounds:
        return weighed(pairs)
    return reduce(DataFrame.unionByName, [stored(weighed(pairs.where(F.col("part") % rounds == k)), "weights", "zstd") for k in range(rounds)])


def ored(slots: DataFrame) -> np.ndarray:
    """As sieve(), of the column data with packed slots, each batch's in parts by range; bits of a range meet by shuffle."""
    size = 1 << (SIEVE_BITS - 6 - RANGE_BITS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                at = np.cumsum(unsqueezed(data.as_py(), 1)[0]).astype(np.int64)
                own = bits.setdefault(p, np.zeros(size, np.int64))
                new = np.flatnonzero(np.append(True, at[1:] >> 6 != at[:-1] >> 6))
                own[at[new] >> 6] |= np.bitwise_or.reduceat(np.int64(1) << (at & 63), new)
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([x.tobytes() for x in bits.values()], pa.binary())], names=["part", "data"])

    with tidy(slots.sparkSession):
        got = slots.repartition(int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(released(join), "part int, data binary").toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for p, data in zip(got.column("part").to_pylist(), got.column("data")):
        out[p * size : (p + 1) * size] = np.frombuffer(data.as_py(), np.int64)
    return out


def packed_slots(keys: np.ndarray) -> pa.RecordBatch:
    at = np.unique(slot(keys))
    bits = SIEVE_BITS - RANGE_BITS
    cuts = np.searchsorted(at >> bits, np.arange((1 << RANGE_BITS) + 1))
    have = np.flatnonzero(np.diff(cuts)).tolist()
    data = [squeezed(np.diff(at[cuts[p] : cuts[p + 1]] - (p << bits), prepend=0)) for p in have]
    return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def pair_slots(pairs: DataFrame) -> DataFrame:
    """For ored(): the slots of all pairs of every_pair()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                v, w, *_ = unpacked_pairs(data.as_py(), 6)
                yield packed_slots(mix(v * np.uint64(0x9E3779B97F4A7C15) ^ mix(w)))

    return pairs.select("data").mapInArrow(released(run), "part int, data binary")


def text_slots(docs: DataFrame) -> DataFrame:
    """For ored(): the slots of the keys of texts, of words, stems and pairs."""
    own = np.uint64((1 << OWN_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            found = [np.zeros(0, np.uint64)]
            for i, j in slices(off):
                t = Terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                found.append(np.unique(np.concatenate([t.word, t.word & ~own, t.pair[~t.opens]])))
            yield packed_slots(np.concatenate(found))

    return docs.select("text").mapInArrow(released(run), "part int, data binary")


def reader(allowed: Broadcast):
    """For ``summed``: the words of a slice of texts, and the pairs of them that the sieve lets through."""

    def read(raw: np.ndarray, off: np.ndarray) -> tuple:
        t = Terms(raw, off)
        doc = t.words.doc()
        spots = np.flatnonzero(~t.opens)
        spots = spots[passes(allowed.value, t.pair[spots])]
        return t.words.per_doc, (t.word, doc), (t.pair[spots], doc[spots])

    return read


def slope(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> float:
    """Of the logistic curve that tells y by x, by Newton steps; above 0."""
    scale = x.std() + 1e-9
    z = np.c_[np.ones(len(x)), (x - x.mean()) / scale]
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
    return max(w[1], 1e-3) / scale


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """Between the two values of x where y is told best, by the harmonic mean of precision and recall, by x being above."""
    by = np.argsort(-x, kind="stable")
    x, hits = x[by], np.cumsum(y[by])
    f = 2 * hits / (np.arange(1, len(x) + 1) + y.sum())
    f[:-1][x[:-1] == x[1:]] = -1
    at = int(f.argmax())
    return float((x[at] + x[min(at + 1, len(x) - 1)]) / 2)


def crc_left(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def toxicity_ratios(docs: DataFrame, labels: DataFrame, held_out: Column | None, fit_rows: int, every: bool = False) -> tuple[DataFrame, tuple[float, float] | None]:
    """The rows of ``docs`` (text and others) without text, with ratio beside; and the slope and the cut of the score, None without both classes.

    With ``every``, all pairs of both classes are learned, by every_pair(); else those of learned_pairs(), which are few.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    if held_out is not None:
        known = known.where(~held_out)
    known = stored(known, "labels")
    half = F.shiftright(F.crc32(F.reverse(F.col("doc_id").cast("string")).cast("binary")), 7) % 2
    beside = lambda ids: docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "doc_id").select("text", "toxic", half.cast("int").alias("half"))
    spark = docs.sparkSession
    bound_batches(spark)
    labelled = beside(known).where("text is not null")
    words = stored(word_counts(labelled), "words")
    sample = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "toxic").limit(fit_rows).drop("order")
    sample = beside(stored(sample, "sample"))
    if every:
        pairs, many = every_pair(labelled, words)
        pairs = stored(pairs, "pairs")
        collected(spark)
        allowed = spark.sparkContext.broadcast(ored(pair_slots(pairs)))
        alone, stems, root, default = word_weights(words)
        alone = alone.select("key", *[F.col("w" + m).cast("float").alias("w" + m) for m in MODELS], "often")
        alone = stored(alone, "weights", "zstd")
        chance = stored(word_chances(words, stems, root, MODELS), "chances")
        drop(words, stems)
        halved = spark.sparkContext.broadcast(ored(text_slots(sample)))  # of the halves' models, no weight is kept that the sample doesn't ask for
        collected(spark)
        table = alone.unionByName(pair_weights(pairs, many, chance, halved, ROUNDS))
        halved.destroy()
        drop(chance, pairs)
        halves = table.where("w_0 is not null")
        collected(spark)
    else:
        pairs = learned_pairs(labelled, words)
        allowed = spark.sparkContext.broadcast(sieve(with_slots(pairs.select("pair"), "pair")))
        table, default = weights(words, pairs)
        halves = table = stored(table, "weights")
    halves = halves.select("key", "w_0", "w_1", "often")
    common = spark.sparkContext.broadcast(common_rows(halves, 2))
    with tidy(spark):
        found = summed(sample, halves, 2, np.array(default[1:]), reader(allowed), common)
        fit = found.select("toxic", (F.when(F.col("half") == 0, F.col("s1")).otherwise(F.col("s0")) / F.greatest("n", F.lit(1))).alias("ratio")).toArrow()
    common.destroy()
    del found, halves
    collected(spark)
    y, x = (fit.column("toxic").to_numpy() == 1).astype(float), fit.column("ratio").to_numpy()
    learned = (slope(x, y), best_cut(x, y)) if 0 < y.sum() < len(y) else None
    out = summed(docs, table.select("key", "w", "often"), 1, np.array(default[:1]), reader(allowed), last=every, rounds=ROUNDS if every else 1)
    return out.withColumn("ratio", F.col("s0") / F.greatest("n", F.lit(1))).drop("n", "s0"), learned


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns ``carry`` and score, from 0 to 1 and higher for a toxic text; other columns are ignored.

    The score rises with the log likelihood ratio of the toxic and the ordinary model, divided by the number of words. Both are interpolated
    Kneser-Ney models: a word given the word before, for all pairs of words in labelled texts of either class, backing off to counts of different pairs that both classes share and
    to the word, then to its first 6 bytes, then to counts of different words that both classes share. A toxic text is taken to have SHARE of its words from the toxic model and the others from the ordinary one, so that
    words that chance put into few texts weigh little.

    ``labels`` has doc_id and toxic (1 or 0); rows with ``held_out`` true (a condition on
    doc_id) or a null in either are not learned from, and rows with the same doc_id but different labels
    count once for each. Words are runs of letters, digits and
    non-ASCII bytes, A-Z lower-cased. Counts are taken over all labelled rows; the table of weights made of them grows
    with the corpus and stays distributed, and texts are not moved: each block of them asks for its words' weights by shuffle. The curve's slope, and the ratio
    at which the score is AT_CUT (that of the best F1), are fitted on at most ``fit_rows`` labelled
    rows, each measured with the counts of the half it is not in. Null and empty texts have the ratio 0. Without both
    classes every score is 0. Repeated rows each give a row, an empty table none. A very long text is worked through whole, in memory of some hundred
    times its length. Columns named text, n, s0, ratio or score can't be in ``carry`` (ValueError).
    """
    if {"text", "n", "s0", "ratio", "score"} & set(carry):
        raise ValueError("carry has a name that the result needs")
    out, learned = toxicity_ratios(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])), labels, held_out, fit_rows, every=True)
    score = F.lit(0.0)
    if learned:
        z = (F.col("ratio") - learned[1]) * learned[0] + float(np.log(AT_CUT / (1 - AT_CUT)))
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return out.select(*carry, score.alias("score"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    left_out = crc_left(F.col("doc_id"), 3) == 1
    out = toxicity_scores(docs, labels, left_out)
    return out.select("doc_id", left_out.alias("held_out"), "score", (F.col("score") >= AT_CUT).cast("int").alias("predicted"))
