"""Weights of keys summed over documents: questions and a large table meet by shuffle; texts stay where they are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.kernels import released, slices, text_bytes
from scriptoria.llm.scratch import drop, stored

#: Bytes of text after which a block is closed. A block asks for each of its keys once.
BLOCK_BYTES = 16 << 20
#: Table rows that a task packs at a time.
PACK_ROWS = 1 << 17
#: Rows at most that are broadcast, the most frequent ones; nobody asks for these. It changes no result but the last digits of sums.
COMMON = 1 << 20
#: Table rows that a part has, about; a task holds one part at a time.
PART_ROWS = 1 << 20
#: A key is that of a group of keys, with these bits 0, and its own number in the group.
OWN_BITS = 24
TABLE, FALLING, EXACT, BASE, REPLY = range(5)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each array in as few bytes a number as its largest takes, byte by byte and compressed."""
    head, body = [], []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
        head += [len(a), size]
        body.append(np.ascontiguousarray(a.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes())
    raw = b"".join(body)
    return np.array([len(raw), *head], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> list[np.ndarray]:
    head = np.frombuffer(data[: 8 + 16 * n], np.int64).tolist()
    raw, at, out = np.frombuffer(pa.decompress(data[8 + 16 * n :], head[0], "zstd") if head[0] else b"", np.uint8), 0, []
    for k in range(n):
        length, size = head[1 + 2 * k : 3 + 2 * k]
        out.append(np.ascontiguousarray(raw[at : at + length * size].reshape(size, length).T).view(f"<u{size}").ravel().astype(np.uint64))
        at += length * size
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["part", "block", "kind", "data"])


def _parts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of keys, by range, so that keys of a part differ by less; a group's keys share one."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, by[cuts[p] : cuts[p + 1]]


def _weights(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    columns = [batch.column(i).to_numpy() for i in range(1 + width)]
    return columns[0].astype(np.int64).view(np.uint64), np.stack(columns[1:], axis=1).astype(np.float64)


def places(have: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``asked`` is in the sorted ``have``, and whether it is there."""
    if not len(have):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return at, have[at] == asked


def common_rows(table: DataFrame, width: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and weights of the rows whose ``often`` is at least the least power of two that leaves no more than ``most``, or COMMON."""
    most = COMMON if most is None else most
    octaves = table.where("often > 0").groupBy(F.floor(F.log2("often")).alias("octave")).count().collect()  # one row for each power of two
    least, rows = 64, 0
    for octave, n in sorted(map(tuple, octaves), reverse=True):
        if rows + n > most:
            break
        least, rows = octave, rows + n
    if not rows:
        return np.zeros(0, np.uint64), np.zeros((0, width))
    got = table.where(F.floor(F.log2("often")) >= least).drop("often").toArrow().combine_chunks()
    k, x = _weights(got, width)
    by = np.argsort(k)
    x = x[by]
    return k[by], x.astype(np.float32) if (x.astype(np.float32) == x).all() else x


def summed(docs: DataFrame, table: DataFrame, width: int, default: np.ndarray, read: Callable, common: Broadcast | None = None, last: bool = False, rounds: int = 1) -> DataFrame:
    """The rows of ``docs`` without text, with n and s0, s1 ... beside: the number of terms of the text, and the sums of ``width`` weights of its keys.

    ``table`` has a long key, of its own in every row, ``width`` doubles, and last ``often``. ``read(raw, off)`` gives, of a slice of texts, the number of terms of each, and
    (keys, documents) twice: of keys that without a row of their own have that of their group, and without one ``default``, and of others, that without a row weigh nothing.

    A block of some BLOCK_BYTES of text looks its common keys up in broadcast rows. Of the others it sends each key with the documents that have it
    to the key's part of the table, in compressed lists; the sums that come from there go to the block's task, with the block's own. A document's terms are never rows.
    ``common``, if given, has common_rows() of the table, so that the caller can delete them. With ``last``, ``table`` is of stored() and deleted as soon as its rows are packed, which take less disk.

    Texts ask in ``rounds``, dealt by a hash of the row: only one round's questions and answers are on disk at a time, beside the table. With more than one, the sums are stored, and the packed rows deleted when all are there.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(tasks // 4, -(-table.count() // PART_ROWS), 1)
    own_common = common is None
    common = common or spark.sparkContext.broadcast(common_rows(table, width))
    keep = [c for c in docs.columns if c != "text"]
    sums = [f"s{i}" for i in range(width)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            k, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            rare = ~places(common.value[0], k)[1]
            k, x = k[rare], x[rare]
            by = np.argsort(k)
            k, x = k[by], x[by]
            return _rows([(p, -1, TABLE, squeezed(np.diff(k[at], prepend=np.uint64(0)), *x[at].T.copy().view(np.uint64))) for p, at in _parts(k, n_parts)])

        for batch in batches:
            held.append(_weights(batch, width))
            if sum(len(h[0]) for h in held) >= PACK_ROWS:
                yield out()
        if held:
            yield out()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, first = TaskContext.get().partitionId() << 32, 0, 0
        lists: dict[int, list] = {FALLING: [], EXACT: []}
        base: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            for kind, found in lists.items():
                if not found:
                    continue
                key, doc, times = (np.concatenate(x) for x in zip(*found))
                found.clear()
                by = np.argsort(key, kind="stable")
                key, doc, times = key[by], doc[by], times[by]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                count, one = np.diff(np.append(new, len(key))), key[new]
                rows = []
                for p, at in _parts(one, n_parts):
                    spot = np.repeat(new[at] - np.append(0, np.cumsum(count[at])[:-1]), count[at]) + np.arange(count[at].sum())
                    rows.append((p, block, kind, squeezed(np.diff(one[at], prepend=np.uint64(0)), count[at] - 1, doc[spot], times[spot] - 1)))
                yield _rows(rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, base[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for b in base:
                    stream.write_batch(b)
            base.clear()
            yield _rows([(block % n_parts, block, BASE, sink.getvalue().to_pybytes())])

        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            n, own = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, width))
            for i, j in slices(off):
                n[i:j], *both = read(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for kind, (key, doc) in zip((FALLING, EXACT), both):
                    one, back = np.unique(key, return_inverse=True)
                    at, hit = places(common.value[0], one)
                    if hit.any():
                        x = np.where(hit[:, None], common.value[1][at], 0)
                        for c in range(width):
                            own[i:j, c] += np.bincount(doc, x[back, c], minlength=j - i)
                    rare = ~hit[back]
                    pair, times = np.unique(back[rare] * (j - i) + doc[rare], return_counts=True)
                    if len(pair):
                        lists[kind].append((one[pair // (j - i)], pair % (j - i) + (first + i), times))
            base.append(pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n), *[pa.array(x) for x in own.T.copy()]], names=[*keep, "n", *sums]))
            first, size = first + batch.num_rows, size + len(raw)
            if size >= BLOCK_BYTES:
                yield from close()
                block, size, first = block + 1, 0, 0
        if base:
            yield from close()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            out = []
            for p, block, kind, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "kind", "data"))):
                if p != now:
                    now, held, part = p, [], None
                if kind == TABLE:
                    key, *x = unsqueezed(data, 1 + width)
                    held.append([np.cumsum(key, dtype=np.uint64), *x])
                    continue
                if kind == BASE:
                    out.append((p, block, kind, data))
                    continue
                if part is None:
                    k = np.concatenate([np.zeros(0, np.uint64), *[h[0] for h in held]])
                    x = np.stack([np.concatenate([np.zeros(0), *[h[1 + c].view(np.float64) for h in held]]) for c in range(width)], axis=1)
                    by, held = np.argsort(k), []
                    part = [k[by], x[by]]
                key, count, doc, times = unsqueezed(data, 4)
                key = np.cumsum(key, dtype=np.uint64)
                at, hit = places(part[0], key)
                x = np.where(hit[:, None], part[1][at], 0.0) if len(part[0]) else np.zeros((len(key), width))
                if kind == FALLING and not hit.all():
                    lost = np.flatnonzero(~hit)
                    at, hit = places(part[0], key[lost] >> np.uint64(OWN_BITS) << np.uint64(OWN_BITS))
                    x[lost] = np.where(hit[:, None], part[1][at], default) if len(part[0]) else default
                x = np.repeat(x, (count + 1).astype(np.int64), axis=0) * (times + 1)[:, None]
                doc = doc.astype(np.int64)
                some = np.flatnonzero(np.bincount(doc))
                out.append((p, block, REPLY, squeezed(some, *[np.bincount(doc, c)[some].view(np.uint64) for c in x.T])))
            yield _rows(out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, replies = None, None, []

        def out() -> pa.RecordBatch:
            table = pa.ipc.open_stream(base).read_all().combine_chunks()
            total = np.stack([table.column(c).to_numpy() for c in sums], axis=1).copy()
            for r in replies:
                doc, *x = unsqueezed(r, 1 + width)
                total[doc.astype(np.int64)] += np.stack([c.view(np.float64) for c in x], axis=1)
            return pa.RecordBatch.from_arrays([*[joined(table.column(c)) for c in [*keep, "n"]], *[pa.array(c) for c in total.T.copy()]], names=[*keep, "n", *sums])

        for batch in batches:
            for block, kind, data in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "data"))):
                if block != now:
                    if now is not None:
                        yield out()
                    now, base, replies = block, None, []
                if kind == BASE:
                    base = data
                else:
                    replies.append(data)
        if now is not None:
            yield out()

    schema = "part int, block long, kind int, data binary"
    packs = table.drop("often").mapInArrow(released(pack), schema)
    if last or rounds > 1:
        packs = stored(packs, "packed")
    if last:
        drop(table)
    done = docs.select(*keep).schema.add("n", "long")
    for s in sums:
        done = done.add(s, "double")

    def answered(some: DataFrame) -> DataFrame:
        asks = packs.unionByName(some.mapInArrow(released(ask), schema))
        answers = asks.repartition(tasks, "part").sortWithinPartitions("part", "block").mapInArrow(released(answer), schema)
        return answers.repartition(tasks, "block").sortWithinPartitions("block", "kind", "part").mapInArrow(released(finish), done)

    if rounds == 1:
        return answered(docs)
    turn = F.pmod(F.xxhash64("text", *[c for c, kind in docs.dtypes if kind in ("bigint", "int", "string") and c != "text"]), F.lit(rounds))
    found = [stored(answered(docs.where(turn == k)), "sums") for k in range(rounds)]
    drop(packs)
    if own_common:
        common.destroy()
    return reduce(DataFrame.unionByName, found)


def joined(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
