"""Language identification by prediction with partial matching over bytes.

For each language a context tree of orders 0 to 4 over bytes is learned from a bounded sample of its
documents and then frozen. A byte is coded at the longest context that has seen it; every longer context
that was seen, but not with this byte, costs its escape (method C: the distinct bytes of a context over
its total plus those); behind order 0 stands the uniform law over 256 bytes. The code length of a text is
the exact sum over all its bytes, and the language with the shortest code wins.

Texts are lower-cased, ASCII characters that aren't letters become spaces, and runs of spaces one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import append_columns, byte_slices, fold, releasing, ship, table

ORDER = 4
DOCS_A_LANGUAGE = 1500  # bound of the training sample: expected distinct texts of each language
UNDETERMINED = "und"
_PLAIN = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")  # Unicode's letters; numeric signs such as one half aren't


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """For every byte, itself behind ``order`` bytes of context, packed big-endian in an integer."""
    x = np.frombuffer(b" " * order + data, dtype=np.uint8).astype(np.int64)
    out = x[: len(data)].copy()
    for k in range(1, order + 1):
        out <<= 8
        out |= x[k : k + len(data)]
    return out


class KeyTable:
    """Positions of int64 keys, by open addressing, for many lookups at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = keys
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        at, todo = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slots[at] != todo
            at, todo = (at[lost] + 1) & (len(self.slots) - 1), todo[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.slots[at]
        todo = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            found[todo] = self.slots[at[todo]]
            todo = todo[(found[todo] >= 0) & (self.keys[found[todo]] != keys[todo])]
        return found


class FrozenTrees:
    """The context trees of all languages, with every seen gram's code length in every language."""

    def __init__(self, languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int = ORDER):
        self.languages, self.order = languages, order
        n = len(languages)
        cost = np.full((256, n), 8.0)
        self.seen, self.cost, self.contexts, self.escape = [], [], [], []
        below = np.arange(256, dtype=np.int64)
        for k in range(order + 1):
            own = gram & ((1 << (8 * (k + 1))) - 1)
            keys = np.arange(256, dtype=np.int64) if k == 0 else np.unique(own)
            at = np.searchsorted(keys, own)
            c = np.zeros((len(keys), n))
            np.add.at(c, (at, language), count)
            contexts, context = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, context, c)
            np.add.at(kinds, context, (c > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(c / (total + kinds)[context])
            lower = cost[np.searchsorted(below, keys & ((1 << (8 * k)) - 1))] if k else cost
            cost = np.where(c > 0, direct, escape[context] + lower)
            below = keys
            self.seen.append(KeyTable(keys))
            self.cost.append(cost.astype(np.float32))
            self.contexts.append(KeyTable(contexts))
            self.escape.append(escape.astype(np.float32))

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of each byte in each language."""
        full = grams(data, self.order)
        out = np.zeros((len(full), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(full))
        for k in range(self.order, -1, -1):
            key = full[todo] & ((1 << (8 * (k + 1))) - 1)
            at = self.seen[k].find(key)
            hit = at >= 0
            if hit.all():
                out[todo] += self.cost[k][at]
                break
            out[todo[hit]] += self.cost[k][at[hit]]
            todo = todo[~hit]
            context = self.contexts[k].find(key[~hit] >> 8)
            known = context >= 0
            out[todo[known]] += self.escape[k][context[known]]
        return out


def draw(rows: DataFrame, most: int = DOCS_A_LANGUAGE) -> tuple[list[str], DataFrame | None]:
    """The languages of rows of (text, lang) without nulls, and their sample: each distinct text of a language
    once, all of them up to ``most``, of more about ``most`` by hash. Copies change neither."""
    # 128 bits tell texts apart
    keyed = rows.select("text", "lang", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(9), "text").alias("g"))
    counted = {r["lang"]: r["n"] for r in keyed.select("lang", "h", "g").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return [], None
    share = F.create_map(*[F.lit(x) for l in sorted(counted) for x in (l, min(1.0, most / counted[l]))])
    drawn = keyed.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    return sorted(counted), drawn.dropDuplicates(["lang", "h", "g"]).select("text", "lang")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = DOCS_A_LANGUAGE, order: int = ORDER) -> FrozenTrees | None:
    """Trees from rows with a text and a language: per language at most about ``most`` distinct texts, drawn
    by hash. Grams are counted in the tasks and summed; None if there is nothing to learn from."""
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    languages, drawn = draw(rows, most)
    if drawn is None:
        return None
    ship(docs.sparkSession)
    number = {l: i for i, l in enumerate(languages)}

    def count(batches):
        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                by: dict[int, list] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by.setdefault(number[lang], []).append(grams(normal(text), order))
                for i, found in by.items():
                    g, c = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, dtype=np.int32)), pa.array(g), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    summed = drawn.mapInArrow(releasing(count), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    summed = summed.sort_values(["lang", "gram"])
    return FrozenTrees(languages, summed["lang"].to_numpy(), summed["gram"].to_numpy(), summed["n"].to_numpy(), order)


def identify(docs: DataFrame, trees: FrozenTrees | None, text_col: str = "text") -> DataFrame:
    """Append lang_pred (string), score (double, the posterior of the winner with equal priors) and
    bits_per_byte (double, the winner's code length over the bytes coded).

    A null text, a text without a letter, and any text while nothing was learned are ``und`` with score
    0 and null bits. Ties go to the language that sorts first. Whole texts are coded, in slices that
    share nothing but the sum. Columns of the appended names are replaced, others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def start():
        own = sent.value

        def step(texts: list) -> list[pa.Array]:
            pred, score, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            data = [(i, normal(t)) for i, t in enumerate(texts) if t and _LETTER.search(t)] if own else []
            data = [(i, d) for i, d in data if d]
            if data:
                joined = (b" " * own.order).join(d for _, d in data)  # each text begins behind spaces
                starts = np.cumsum([0] + [len(d) + own.order for _, d in data[:-1]])
                lengths = np.array([len(d) for _, d in data])
                sums = np.zeros((len(data), len(own.languages)))
                width = max(1 << 14, (1 << 20) // max(1, len(own.languages) // 4))
                for a in range(0, len(joined), width):
                    part = joined[max(0, a - own.order) : a + width]
                    cost = own.code_lengths(part)[min(a, own.order) :]
                    lo, hi = np.clip(starts - a, 0, len(cost)), np.clip(starts + lengths - a, 0, len(cost))
                    some = np.flatnonzero(hi > lo)
                    if len(some):
                        edges = np.empty(2 * len(some), dtype=np.int64)
                        edges[0::2], edges[1::2] = lo[some], hi[some]
                        padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), dtype=np.float32)]).astype(np.float64)
                        sums[some] += np.add.reduceat(padded, edges, axis=0)[0::2]
                best = np.argmin(sums, axis=1)
                low = sums[np.arange(len(data)), best]
                post = 1.0 / np.exp2(np.maximum(low[:, None] - sums, -1000)).sum(axis=1)
                for (i, _), b, p, w, n in zip(data, best.tolist(), post.tolist(), low.tolist(), lengths.tolist()):
                    pred[i], score[i], bits[i] = own.languages[b], p, w / n
            return [pa.array(pred, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(bits, type=pa.float64())]

        return step

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    return append_columns(docs, text_col, fields, start)


def held_out(id_col: Column) -> Column:
    return fold(id_col, 4) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of every document; trees are learned from rows that aren't
    held out. Repeated rows get equal results, an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = learn(docs.where(~held_out(docs["doc_id"])))
    return identify(docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text"), trees).drop("text")
