"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would
form, leftmost first among equals, and merges from the top until no pair forms a piece. A text is cut
before every run of the space mark first. That is exact when no piece holds the mark behind another
character, which is verified when the vocabulary is loaded; otherwise a text stays one segment.
Segments repeat, so a task remembers the ids of those it has met (a bounded memory that only saves
time and ends with the task). Short new segments of a batch are merged together, one agenda step for all of them at a time in
numpy; long ones use a heap. Every new segment is checked against the sentencepiece library in the
batch it appears in, and a difference raises. Decoding is the library's.
"""

from __future__ import annotations

import gc
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import append_columns, table

MARK = "▁"  # stands for a space in pieces
LONG = 96  # symbols from which a segment has an agenda of its own
REMEMBERED = 200_000  # segments a task remembers, some 200 bytes each


class MergeCodec:
    """Encoder of one model, from the bytes of its model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.bytes = {i: self.library.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        self.cuts = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.n = n
        symbols = dict(self.ids)
        for piece in self.ids:  # characters that occur in pieces only
            for c in piece:
                symbols.setdefault(c, len(symbols) + n)
        width = max(symbols.values()) + 1
        self.score = np.full(width, -np.inf)
        self.score[list(self.ids.values())] = [self.library.get_score(i) for i in self.ids.values()]
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.by_char = np.full(0x110000, -1, dtype=np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.by_char[ord(s)] = i
        self.interned = np.array([*range(width), -1], dtype=object)  # one int object for each id

    def _heap(self, segment: str) -> list[int]:
        """The agenda as a heap over linked symbols: for long segments."""
        symbol = self.by_char[np.frombuffer(segment.encode("utf-32-le"), dtype=np.uint32)].tolist()
        size, left, right = [1] * len(symbol), list(range(-1, len(symbol) - 1)), [*range(1, len(symbol)), -1]
        agenda: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbol[a] >= 0 and symbol[b] >= 0 and (i := self.pairs.get(symbol[a] << 32 | symbol[b])) is not None:
                heapq.heappush(agenda, (-self.score[i], a, b, size[a], size[b], i))

        for a in range(len(symbol) - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, was_a, was_b, i = heapq.heappop(agenda)
            if size[a] != was_a or size[b] != was_b:  # one of them has been merged meanwhile
                continue
            symbol[a], size[a], size[b] = i, was_a + was_b, 0
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out, at = [], 0
        while at >= 0:
            out.append((symbol[at], segment[at : at + size[at]]))
            at = right[at]
        return list(chain.from_iterable(self._final(i, s) for i, s in out))

    def _final(self, symbol: int, text: str) -> list[int]:
        return [symbol] if 0 <= symbol < self.n else [self.bytes[b] for b in text.encode()]

    def _together(self, segments: list[str]) -> list[list[int]]:
        """One agenda step for all segments at a time."""
        text = "".join(segments)
        symbol = self.by_char[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        start = np.arange(len(symbol))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            piece = np.where(self.keys[at] == key, self.made[at], -1)
            return piece, np.where(piece >= 0, self.score[piece], -np.inf)

        piece, score = look(symbol, np.append(symbol[1:], -1))
        last = np.append(owner[1:] != owner[:-1], True)
        piece[last], score[last] = -1, -np.inf
        while len(symbol):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.maximum.reduceat(score, heads)
            lengths = np.diff(np.append(heads, len(symbol)))
            ended = np.repeat(best == -np.inf, lengths)
            if ended.any():
                done.append((owner[ended], symbol[ended], start[ended]))
                owner, symbol, start, piece, score = (x[~ended] for x in (owner, symbol, start, piece, score))
                best, lengths = best[best != -np.inf], lengths[best != -np.inf]
                if not len(symbol):
                    break
            hit = np.flatnonzero(score == np.repeat(best, lengths))
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]  # the leftmost of each segment
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the merged symbols stand once the gaps are closed
            owner, symbol, start, piece, score = (x[keep] for x in (owner, symbol, start, piece, score))
            again = np.concatenate([moved, moved[moved > 0] - 1])
            follows = again + 1
            inside = follows < len(symbol)
            inside[inside] = owner[follows[inside]] == owner[again[inside]]
            piece[again], score[again] = -1, -np.inf
            again = again[inside]
            piece[again], score[again] = look(symbol[again], symbol[again + 1])
        owner, symbol, start = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start, kind="stable")
        owner, symbol, start = owner[order], symbol[order], start[order]
        heads = np.searchsorted(owner, np.arange(len(segments) + 1)).tolist()
        listed = self.interned[symbol].tolist()
        out = [listed[a:b] for a, b in zip(heads, heads[1:])]
        for k in np.unique(owner[(symbol < 0) | (symbol >= self.n)]).tolist():  # bytes of unknown characters
            ends = [*start[heads[k] + 1 : heads[k + 1]].tolist(), start[heads[k]] + len(segments[k])]
            out[k] = list(chain.from_iterable(self._final(i, text[a:b]) for i, a, b in zip(out[k], start[heads[k] : heads[k + 1]].tolist(), ends)))
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}]*", marked) if self.cuts else [marked]

    def _learn(self, new: list[str]) -> dict[str, tuple]:
        short, long = [s for s in new if len(s) <= LONG], [s for s in new if len(s) > LONG]
        made = [*(self._together(short) if short else []), *map(self._heap, long)]
        said = self.library.encode([s[1:].replace(MARK, " ") if s != MARK else "" for s in (*short, *long)], num_threads=1)
        if made != said:
            for s, own, other in zip((*short, *long), made, said):
                if own != other and s != MARK:  # the library has no segment that is only its own prefix
                    raise ValueError(f"the agenda and the library differ on {s[:80]!r}: {own[:20]} and {other[:20]}")
        return dict(zip((*short, *long), map(tuple, made)))

    def encode(self, texts: list[str], known: dict[str, tuple] | None = None) -> list[list[int]]:
        """Ids of each text. ``known`` are the segments remembered from earlier calls; this one adds its own."""
        known = {} if known is None else known
        cut = [self.segments(t) for t in texts]
        met = set().union(*cut)
        new = list(met.difference(known))
        if new:
            found = self._learn(new)
            if len(known) + len(found) > REMEMBERED:  # keep what this batch uses and forget the rest
                used = {s: known[s] for s in met.intersection(known)}
                known.clear()
                known.update(used)
            known.update(found)
        return [list(chain.from_iterable(map(known.__getitem__, c))) for c in cut]


_CODECS: dict[bytes, MergeCodec] = {}


def codec_of(model: bytes) -> MergeCodec:
    """The codec that this Python worker keeps from task to task: some 25 MB of tables."""
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = MergeCodec(model)
        gc.freeze()  # the tables live as long as the worker; there is no need to scan them again
        gc.set_threshold(200_000, 50, 1000)
    return _CODECS[model]


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Append ``ids`` (array of int) and ``decoded`` (string) to every row.

    The ids are those of the whole text without begin or end ids; the model file is read on the driver
    and sent to the tasks (half a megabyte). A null text counts as empty; an empty text has no ids and
    decodes to the empty text. Equal texts get equal results; texts may be of any length. Other columns
    pass through, columns named ``ids`` or ``decoded`` are replaced. An empty table stays empty.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def start():
        codec, memory = codec_of(model), {}

        def step(texts: list) -> list[pa.Array]:
            ids = codec.encode([t or "" for t in texts], memory)
            decoded = codec.library.decode(ids, num_threads=1) if ids else []
            return [pa.array(ids, type=pa.list_(pa.int32())), pa.array(decoded, type=pa.string())]

        return step

    return append_columns(docs, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], start, 1 << 20)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``encode_decode``."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, null texts as empty ones; see ``encode_decode``."""
    return digests(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model()))
