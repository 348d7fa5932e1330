"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word features is trained in numpy from confirmed toxic texts (P) and unlabelled
texts (U): documents of the labelled set, drawn and used without regard to their label. Only features clearly more
frequent in P than in U get a weight. With class prior pi the risk is
pi R_P+ + max(0, R_U- - pi R_P-): where the corrected negative part of a mini-batch falls below zero the
step goes the other way, so that a flexible model can't drive the estimate below zero by learning the
positives by heart. No clean label is ever looked at: pi is the least ratio of the tails of U and P among
scores of documents that the model was not trained on, and the decision is the sign of the margin, which is what
the risk is minimised for.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import append_columns, byte_slices, fold, materialize, releasing, ship, table

LIFT = 2.5  # a feature's share of P over its share of U, from which it counts
LEAST = 3  # positive documents that must have it
POSITIVES = 4000  # bounds of the training sample, both drawn from labelled documents
UNLABELLED = 8000
STEPS = 600  # of a small sample, at least
WORDS_REMEMBERED = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """The word and its beginnings of 3 to 8 letters, as 32-bit hashes."""
    return [zlib.crc32(b"w" + word.encode()), *(zlib.crc32(b"b" + word[:k].encode()) for k in range(3, min(9, len(word) + 1)))]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def document_features(text: str) -> np.ndarray:
    """Features of the distinct words; one that several words share comes several times."""
    return np.array([f for w in words_of(text) for f in word_features(w)], dtype=np.uint32)


class LinearModel:
    def __init__(self, weights: dict[int, float], bias: float, scale: float):
        self.weights, self.bias, self.scale = weights, bias, scale

    def value(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))

    def margin(self, text: str, known: dict[str, float] | None = None) -> float:
        """Sum over the distinct words, so the order and the number of repeats don't count. ``known`` remembers
        the values of words from call to call."""
        words, known = words_of(text), {} if known is None else known
        for w in words.difference(known):
            known[w] = self.value(w)
        z = math.fsum(map(known.__getitem__, words)) + self.bias  # exact, so in any order the same
        if len(known) > WORDS_REMEMBERED:
            known.clear()
        return z

    def score(self, text: str | None, known: dict[str, float] | None = None) -> float:
        x = self.margin(text or "", known) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _above(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of the ascending z at or above each cut."""
    return 1 - np.searchsorted(z, cuts) / len(z)


def class_prior(zp: np.ndarray, zu: np.ndarray, sure: float = 0.9) -> float:
    """Share of positives in U from scores of documents that weren't trained on: the ratio of the shares of U
    and P above a cut is at least pi for every cut, and nears it where no negative is above. The cut is that of
    the least upper bound of this ratio, so that a few documents in a tail don't decide it."""
    zp, zu = np.sort(zp), np.sort(zu)
    cuts = np.unique(zp)
    p, u = _above(zp, cuts), _above(zu, cuts)
    slack = math.sqrt(math.log(4 / (1 - sure)) / 2) * (len(zp) ** -0.5 + len(zu) ** -0.5)
    best = int(np.argmin((u + slack) / p))
    return float(min(0.9, max(0.001, u[best] / p[best])))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float | None, rounds: int = 60, batch: int = 256, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias by mini-batches of both samples with Adagrad steps on the nnPU risk, sigmoid loss. Without a
    prior the risk is that of telling P from U, which orders documents before the prior is known.

    A document is an array of feature numbers below ``width``, with repeats.
    """
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior))) if prior else 0.0
    past, past_bias = np.full(width, 1e-4), 1e-4

    def margins(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.bincount(owner, w[flat], len(rows)) + bias, flat, owner

    for _ in range(max(rounds, STEPS * batch // len(unlabelled))):
        order_u, order_p = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        steps = max(1, -(-len(order_u) // batch))
        share = max(1, -(-len(order_p) // steps))
        for k in range(steps):
            p = [positive[i] for i in np.take(order_p, range(k * share, (k + 1) * share), mode="wrap")]
            u = [unlabelled[i] for i in order_u[k * batch : (k + 1) * batch]]
            zp, fp, op = margins(p)
            zu, fu, ou = margins(u)
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
            dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)  # slopes of the sigmoid loss
            if prior is None:
                gp, gu = -dp, du
            elif su.mean() - prior * sp.mean() >= 0:
                gp, gu = -2 * prior * dp, du
            else:
                gp, gu = prior * dp, -du
            g = np.bincount(np.concatenate([fp, fu]), np.concatenate([gp[op], gu[ou]]), width) + decay * w
            past += g * g
            w -= rate * g / np.sqrt(past)
            gb = gp.sum() + gu.sum()
            past_bias += gb * gb
            bias -= rate * gb / np.sqrt(past_bias)
    return w, bias


def chosen_features(sample: DataFrame) -> np.ndarray:
    """Ascending features that at least LEAST of P have, at LIFT times their share of U, of a sample (y, f).

    Documents are counted in the tasks, batch by batch, and summed by a shuffle on the feature.
    """

    def count(batches):
        for batch in batches:
            y, lists = batch.column("y").to_numpy(), batch.column("f")
            flat, owner = _flat(lists)
            for label in (1, -1):
                own = y[owner] == label
                once = np.unique(flat[own].astype(np.int64) << 32 | owner[own])  # a document counts once
                keys, n = np.unique(once >> 32, return_counts=True)
                none = np.zeros(len(keys), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n if label == 1 else none), pa.array(n if label == -1 else none)], names=["feature", "p", "u"])

    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    counted = sample.mapInArrow(releasing(count), "feature bigint, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    more = (F.col("p") + 0.5) / (size.get(1, 0) + 1) >= LIFT * (F.col("u") + 0.5) / (size.get(-1, 0) + 1)
    chosen = counted.where((F.col("p") >= LEAST) & more).select("feature").toArrow().column("feature").to_numpy()
    return np.sort(chosen).astype(np.uint32)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array, and the number of the list that each stands in."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.repeat(np.arange(len(lists)), lengths)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> LinearModel | None:
    """A model from the labels given (pass those of the training folds only) and the texts of ``docs``.

    Of the labelled documents about ``positives`` toxic ones are drawn by hash as P and about ``unlabelled`` of any label as
    U; where several rows bear an id the text that sorts first counts once. Features are chosen by
    counts over the whole sample, made in the tasks; to the driver come the numbers of each document's
    chosen features. Null labels and ids take no part, a null text counts as empty. With no toxic document there is no model.
    """
    marks = labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_y")).where("_y is not null and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    known = marks.agg(F.count_if(F.col("_y") == 1).alias("p"), F.count("*").alias("u")).first()
    if not known["p"]:
        return None
    drawn = lambda salt, share: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    p = marks.where(F.col("_y") == 1).where(drawn(1, positives / known["p"])).select("_id", F.lit(1).alias("y"))
    u = marks.where(drawn(2, unlabelled / known["u"])).select("_id", F.lit(-1).alias("y"))
    few = F.broadcast(p.union(u))  # some 12,000 ids: drawn to the bounds above, whatever the input
    sample = rows.join(few, "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    sample = sample.select("text", "y", (F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(2)) == 0).alias("half"))

    def features(batches):
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                made = [document_features(t).view(np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("half"), pa.array(made, type=pa.list_(pa.int32()))], names=["y", "half", "f"])

    ship(docs.sparkSession)
    sample = materialize(sample.mapInArrow(releasing(features), "y int, half boolean, f array<int>"))
    keys = chosen_features(sample)

    def keep(batches):
        """Numbers of a document's chosen features, ascending, with repeats."""
        for batch in batches:
            flat, owner = _flat(batch.column("f"))
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            kept = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            ends = np.searchsorted(owner[kept], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("half"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[kept].astype(np.int32)))], names=["y", "half", "f"])

    got = sample.mapInArrow(releasing(keep), "y int, half boolean, f array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    y, half, lists = got.column("y").to_numpy(), got.column("half").to_numpy(), got.column("f").chunk(0)
    at, ends = lists.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    rows_of = lambda which: sorted((np.sort(at[ends[i] : ends[i + 1]]) for i in np.flatnonzero(which)), key=lambda a: (len(a), a.tobytes()))
    return fitted(keys, *(rows_of((y == v) & (half == h)) for v in (1, -1) for h in (True, False)))


def fitted(keys: np.ndarray, pos_a: list, pos_b: list, unl_a: list, unl_b: list) -> LinearModel | None:
    """The model from two halves of P and of U, documents as arrays of positions in ``keys``."""
    pos, unl, width = pos_a + pos_b, unl_a + unl_b, max(1, len(keys))
    if not pos or not unl:
        return None
    z = lambda w, bias, rows: np.array([w[r].sum() + bias for r in rows])
    own = (pos_a or pos, unl_a or unl), (pos_b or pos, unl_b or unl)
    priors = []
    for (p, u), (other_p, other_u) in (own, own[::-1]):  # each half is scored by the model of the other one
        first = train(p, u, width, None)
        priors.append(class_prior(z(*first, other_p), z(*first, other_u)))
    prior = sum(priors) / 2
    w, bias = train(pos, unl, width, prior)
    scale = max(1e-3, float(np.median(np.abs(z(w, bias, pos + unl)))) / 4)  # scores spread over (0, 1)
    return LinearModel(dict(zip(keys.tolist(), w.tolist())), bias, scale)


def score(docs: DataFrame, model: LinearModel | None, text_col: str = "text") -> DataFrame:
    """Append score (double, 0 to 1) and predicted (int, 1 from 0.5 on) to every row.

    Whole texts are scored; a null text counts as empty and scores like it. Without a model every
    score is 0. Columns of these names are replaced, others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own, known = sent.value, {}

        def step(texts: list) -> list[pa.Array]:
            made = [own.score(t, known) for t in texts] if own else [0.0] * len(texts)
            return [pa.array(made, type=pa.float64()), pa.array([int(x >= 0.5) for x in made], type=pa.int32())]

        return step

    return append_columns(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)


def held_out(id_col: Column) -> Column:
    return fold(id_col, 5) == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out ids are never read. Repeated rows
    get equal scores, a null or empty text that of the empty text; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.where(~held_out(labels["doc_id"])))
    return score(docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text"), model).drop("text")
