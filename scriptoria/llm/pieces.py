"""Encoding and decoding with a SentencePiece merge-type model by a prefix table."""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.kernels import released
from scriptoria.llm.scratch import bound_batches

#: Entries that each of the two generations of a worker's memory holds; longer segments (in bytes) are not remembered.
MEMORY, MEMORY_BYTES = 60_000, 48
#: Tested pairs of pieces that a worker holds before it forgets them.
PAIRS = 250_000
SPACE = "▁"
_MODELS: dict[str, PieceModel] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is text, byte or mark. Models that normalise text or hold user-defined pieces are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    rule = spec.normalizer_spec
    if spec.trainer_spec.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
        raise ValueError("only merge-type models with byte fallback, identity normalisation and a space put in front are handled")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = {1: "text", 2: "mark", 3: "mark", 6: "byte"}
    return [(p.piece, sp.get_score(i), kinds[p.type]) for i, p in enumerate(spec.pieces)]


class Memory(dict):
    """Results of ``work`` by argument; when full, they become the older generation, from which those asked for again come back."""

    def __init__(self, work):
        self.work, self.older = work, {}

    def __missing__(self, x):
        out = self.older.get(x)
        if out is None:
            out = self.work(x)
        if len(x) <= MEMORY_BYTES:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[x] = out
        return out

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Neighbours(dict):
    """Whether a piece is compatible with each piece before it, tested when first asked."""

    __slots__ = ("model", "piece")

    def __init__(self, model: PieceModel, piece: str):
        self.model, self.piece = model, piece

    def __missing__(self, before: str) -> bool:
        self.model.make_room()
        out = self[before] = self.model.compatible(before, self.piece)
        return out


class PieceModel:
    """Encoder and decoder for one vocabulary.

    The merge procedure gives every text exactly one sequence of pieces, and
    a sequence is the right one if and only if each two neighbours are: merging their
    joined text gives back the two. So the last piece of each prefix is unique, and it is
    the one piece that ends there whose text merges to itself and that is
    compatible with the last piece of the prefix before it.
    """

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.score = {p: s for p, s, kind in vocabulary if kind == "text"}
        self.id = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "text"}
        byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.byte = [byte[b].to_bytes(4, "little") for b in range(256)]
        self.begin, self.end = (next(i for i, (p, _, _) in enumerate(vocabulary) if p == m).to_bytes(4, "little") for m in ("<s>", "</s>"))
        self.surface = pa.array([b"" if kind == "mark" else bytes([int(p[1:-1], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() for p, _, kind in vocabulary], pa.large_binary())
        self.automaton, self.neighbours, self.tested = ahocorasick.Automaton(), [], 0
        self.ends: dict[str, tuple] = {}
        for p in self.id:
            if self.merge(p)[0] == [p]:  # others end no text
                self.neighbours.append(Neighbours(self, p))
                self.automaton.add_word(p, (len(p), p, self.id[p].to_bytes(4, "little"), self.neighbours[-1]))
        self.automaton.make_automaton()
        self.encoded = Memory(self.encode_segment)
        # whether a merge can cross the place between two bytes: inside a character, or as two characters beside each other in a piece end and begin
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for p in self.id:
            spelt = [c.encode() for c in p.replace(SPACE, " ")]
            for x, y in zip(spelt, spelt[1:]):
                self.joined[x[-1], y[0]] = True
        self.joined = self.joined.ravel()

    def merge(self, text: str) -> tuple[list[str], tuple, tuple]:
        """The merge procedure itself: the best-scored, then leftmost, pair of neighbours whose joined text is a piece.

        Also the parts that stood first, one after the other, with the worst score of the merges during each one's stay, its own end included (-inf: it
        stays); and those that stood last.
        """
        parts, score = list(text), self.score
        first, last, first_worst, last_worst = [], [], inf, inf
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if best < first_worst:
                first_worst = best
            if best < last_worst:
                last_worst = best
            if at == 0:
                first.append((parts[0], first_worst))
                first_worst = inf
            if at == len(parts) - 2:
                last.append((parts[-1], last_worst))
                last_worst = inf
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, tuple(zip(*first, (parts[0], -inf))), tuple(zip(*last, (parts[-1], -inf)))

    def compatible(self, before: str, after: str) -> bool:
        """Whether merging the joined text of two pieces (or characters) gives back the two.

        It does unless a merge crosses their border. Until one does, each merges as it would alone, the better score next, so of the parts at the border that
        one goes first whose stay has the better worst score; both are there when that worst merge is next, and then their own merge must not come before it.
        """
        for x in (before, after):
            if x not in self.ends:
                self.ends[x] = self.merge(x)[1:]
        (left, left_worst), (right, right_worst) = self.ends[before][1], self.ends[after][0]
        i = j = 0
        while True:
            x, y, across = left_worst[i], right_worst[j], self.score.get(left[i] + right[j])
            if x == y == -inf:
                return across is None
            if x >= y:
                if across is not None and across > x:  # of equal scores the left one merges first
                    return False
                i += 1
            else:
                if across is not None and across >= y:
                    return False
                j += 1

    def make_room(self) -> None:
        """Count a pair about to be tested; at PAIRS of them all are forgotten."""
        if self.tested >= PAIRS:
            self.forget_pairs()
        self.tested += 1

    def forget_pairs(self) -> None:
        for known in self.neighbours:
            known.clear()
        self.ends.clear()
        self.tested = 0

    def forget(self) -> None:
        """Drop all that was remembered of texts."""
        self.encoded.forget()
        self.forget_pairs()

    def encode_segment(self, spelt: bytes) -> bytes:
        """Ids as little-endian 32-bit integers. ``last[i]`` is the last piece of the first i characters; none for one that no piece has."""
        segment = spelt.decode().replace(" ", SPACE)
        last: list[tuple | None] = [None] * (len(segment) + 1)
        for end, entry in self.automaton.iter(segment):
            end += 1
            if last[end] is None:
                begin = end - entry[0]
                if begin:
                    known = last[begin]
                    if not entry[3][known[1] if known else segment[begin - 1]]:
                        continue
                last[end] = entry
        out, i = [], len(segment)
        while i:
            entry = last[i]
            if entry is None:
                i -= 1
                out.append(b"".join([self.byte[x] for x in segment[i].encode()]))
            else:
                out.append(entry[2])
                i -= entry[0]
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. All are cut wherever no merge can cross, and each different segment is encoded once."""
        spelt = [(SPACE + t).replace(SPACE, " ").encode() if t else b"" for t in texts]
        ends = np.append(0, np.cumsum([len(x) for x in spelt], dtype=np.int64))
        raw = np.frombuffer(b"".join(spelt), np.uint8)
        if not len(raw):
            return spelt
        del spelt
        cut = np.ones(len(raw) + 1, bool)
        pairs = raw[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= raw[1:]
        np.logical_not(self.joined[pairs], out=cut[1:-1])
        del pairs
        cut[ends] = True
        at = np.flatnonzero(cut)
        segments = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        _, offsets, data = segments.dictionary.buffers()
        different, bounds = data.to_pybytes(), np.frombuffer(offsets, np.int64)[: len(segments.dictionary) + 1].tolist()
        known = pa.array([self.encoded[different[a:b]] for a, b in zip(bounds, bounds[1:])], pa.large_binary())
        _, offsets, data = known.take(segments.indices).buffers()
        bounds = np.frombuffer(offsets, np.int64)[np.searchsorted(at, ends)].tolist()
        ids = data.to_pybytes()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Texts of ids, in UTF-8, without the space put in front; control ids give nothing."""
        taken = self.surface.take(pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        ends = np.append(0, np.cumsum([len(x) // 4 for x in ids]))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[ends].tolist() if len(taken) else [0] * len(ends)
        raw = data.to_pybytes() if data is not None else b""
        return [raw[a + raw.startswith(b" ", a, b) : b] for a, b in zip(at, at[1:])]


def encode_texts(docs: DataFrame, model: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns ``carry``, n_tokens, ids (little-endian unsigned 32-bit integers, begin and end ids included), decoded.

    ``model`` is the path of the model file on the driver; its vocabulary goes to the executors with the
    tasks. A null text counts as empty and has the begin and end ids alone.
    Whole texts are encoded; a text without a place that no piece crosses is one segment, worked through in one pass.
    Repeated rows each give a row, an empty table none, other columns are ignored.
    """
    path = model or default_model()
    bound_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _MODELS.get(path)
        if own is None:
            own = _MODELS[path] = PieceModel(vocabulary.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [own.begin + x + own.end for x in own.encode_all([text or "" for text in batch.column("text").to_pylist()])]
                n, decoded = [len(x) // 4 for x in ids], own.decode(ids)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())], names=[*carry, "n_tokens", "ids", "decoded"])
        own.forget()  # the worker lives on, for other work

    schema = docs.select(*carry).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(released(run), schema)


def op10_query(spark, sf_dir: str) -> DataFrame:
    out = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
