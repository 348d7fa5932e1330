"""How the sources of a language differ in their use of words, exactly.

Pass one finds in how many documents of a language each term stands; terms in ``least_docs`` of them are kept. Pass
two counts the kept terms' occurrences: texts become their terms between single delimiters, and an automaton over the
kept terms of the language, each with a delimiter at both ends, runs over them once. Both passes count inside a task and
hand over sums, so a hot language or source costs no more than others. The automaton's terms are bounded in bytes: a
larger vocabulary is dealt into blocks by a hash of the term, each with a pass of its own.

The sums (language, source, term, count) are sparse postings. Smoothed shares p of each group and language come from
them in whole numbers. For pairs of sources the terms of a language are dealt into blocks of so many terms that terms times
sources stay below ``CELLS``: a block adds up |p - p'| over its terms for each pair, blocks are summed, ranked and, for
the term part, cut to the first ranks.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import quoted, releasing, ship, table, written

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
HELD = 500_000  # counters that a task holds before it hands them over
VOCABULARY_BYTES = 8 << 20  # kept terms of one automaton pass
CELLS = 4_000_000  # terms times sources of one block of the pair sums
# letters stay, A-Z in lower case, and so do all bytes of other characters; the rest are delimiters
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def automaton(words: Iterable[str]):
    """An automaton that finds each of the words between delimiters and tells it."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(f" {w} ", w)
    found.make_automaton()
    return found


def occurrences(machine, text: bytes) -> Iterator[str]:
    padded = b" %b " % text.translate(NORMAL)
    return map(itemgetter(1), machine.iter(padded.decode("utf-8", "surrogateescape")))


class _Sums:
    """Counters by key, handed over as Arrow batches whenever they grow large."""

    def __init__(self, names: list[str]):
        self.names, self.counts, self.size = names, defaultdict(Counter), 0

    def add(self, key: tuple[str, ...], found: Iterable) -> None:
        own = self.counts[key]
        before = len(own)
        own.update(found)
        self.size += len(own) - before

    def batches(self, at_least: int) -> Iterator[pa.RecordBatch]:
        if self.size < at_least or not self.size:
            return
        for key, own in self.counts.items():
            said = [t.encode("utf-8", "surrogateescape") if isinstance(t, str) else t for t in own]
            columns = [pa.array([part] * len(own), pa.string()) for part in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.binary()), pa.array(list(own.values()), pa.int64())], names=self.names)
        self.counts.clear()
        self.size = 0


def _count(docs: DataFrame, keys: list[str], start: Callable[[], Callable]) -> DataFrame:
    """(keys, term, n), summed inside tasks, of what ``start()(key, text)`` finds in each text."""
    ship(docs.sparkSession)
    names = [*keys, "term", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sums = start(), _Sums(names)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, text in enumerate(batch.column("text")):
                key = tuple(c[i] for c in columns)
                found = find(key, text.as_py())
                if found is not None:
                    sums.add(key, found)
                    yield from sums.batches(HELD)
        yield from sums.batches(1)

    schema = ", ".join([*[f"{k} string" for k in keys], "term binary", "n bigint"])
    return docs.select(*keys, F.col("text").cast("binary").alias("text")).mapInArrow(releasing(run), schema).withColumn("term", F.col("term").cast("string"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many rows of (lang, text) each term stands."""
    return _count(docs, ["lang"], lambda: lambda key, text: set(terms(text))).groupBy("lang", "term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n > 0): how often the kept (lang, term) occur in (lang, source, text)."""
    sc = docs.sparkSession.sparkContext
    size = kept.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    blocks = max(1, math.ceil(size / VOCABULARY_BYTES))
    out = None
    for k in range(blocks):  # one, unless the vocabulary is large
        vocabulary = defaultdict(list)
        for r in kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).select("lang", "term").toLocalIterator():  # about VOCABULARY_BYTES
            vocabulary[r["lang"]].append(r["term"])
        shared = sc.broadcast(dict(vocabulary))

        def start(shared=shared):
            machines = {}

            def find(key, text):
                lang = key[0]
                if lang not in machines:
                    own = shared.value.get(lang)
                    machines[lang] = automaton(own) if own else None
                return occurrences(machines[lang], text) if machines[lang] else None

            return find

        made = _count(docs, ["lang", "source"], start)
        out = made if out is None else out.union(made)
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, words: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * words)) in whole numbers of any size."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (F.coalesce(n, F.lit(0)) + PRIOR).cast("decimal(20,0)")
    down = F.coalesce(total, F.lit(0)) + F.lit(PRIOR) * words
    ratio = F.call_function("div", up, F.nullif(down, F.lit(0)).cast("decimal(20,0)"))
    return F.lit(1) + F.coalesce(ratio, F.lit(0))


def _pair_block(key, own: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of |p - p'| over the terms of a block, for each two sources of its language."""
    names = sources.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode("utf-8", "surrogateescape"))
    names = [names[i] for i in order]
    rest = sources.column("rest").to_numpy()[order]
    number = {s: i for i, s in enumerate(names)}
    found = own.column("term").dictionary_encode().combine_chunks()
    found = found if isinstance(found, pa.DictionaryArray) else found.chunk(0)
    width = len(found.dictionary)
    p = np.repeat(rest[:, None], width, axis=1)
    p[np.array([number[s] for s in own.column("source").to_pylist()], dtype=np.int64), found.indices.to_numpy()] = own.column("p").to_numpy()
    a, b, v = [], [], []
    for i in range(len(names) - 1):
        a += [names[i]] * (len(names) - 1 - i)
        b += names[i + 1 :]
        v.append(np.abs(p[i + 1 :] - p[i]).sum(axis=1))
    values = np.concatenate(v) if v else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(values, pa.int64())})


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    A term is a run of letters A-Z, a-z and characters beyond ASCII, with A-Z in lower case. A language keeps the terms
    that stand in ``least_docs`` of its rows. A group's and a language's share of a kept term is p = 1 + floor(10^9 *
    (count + 5) / (N + 5 V)), N their occurrences of all V kept terms. Part ``pair``: for each other source of the
    language the sum of |p - p'|, 0 without kept terms; it has as many rows as there are ordered pairs of sources. Part
    ``term``: the terms that the group has and uses more than its language, with the difference, ranks to ``top``. Ranks
    descend by value, ties by the item's UTF-8 bytes. Nulls count as empty strings, repeated rows count each; an empty
    table gives no row.
    """
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    docs = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = written(document_frequencies(docs.select("lang", "text")).where(F.col("n") >= least_docs).select("lang", "term"))
    counts = written(postings(docs, kept))
    words = kept.groupBy("lang").agg(F.count("*").alias("words"))
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = written(groups.join(words, "lang", "left").select("lang", "source", "total", F.coalesce("words", F.lit(0)).alias("words")))
    shares = written(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "words", _share(F.col("n"), F.col("total"), F.col("words")).alias("p")))

    sizes = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.max("words") * F.count("*") / CELLS)).cast("int").alias("blocks"))
    sources = groups.select("lang", "source", _share(F.lit(0), F.col("total"), F.col("words")).alias("rest")).join(sizes, "lang")
    sources = sources.select("lang", "source", "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = shares.join(sizes, "lang").select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    ship(df.sparkSession)
    sums = blocks.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block")).applyInArrow(_pair_block, "lang string, a string, b string, value bigint")
    sums = written(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"))
    all_of = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    more = shares.join(whole, ["lang", "term"]).join(all_of, "lang").withColumn("value", F.col("p") - _share(F.col("whole"), F.col("all"), F.col("words"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda t: t.withColumn("rank", F.row_number().over(order))
    columns = lambda t, part: t.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    first = ranked(more.withColumnRenamed("term", "item")).where(F.col("rank") <= top)
    return columns(ranked(both), "pair").union(columns(first, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT l.lang, count(kept.term) AS words FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT g.lang, g.source, words, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * words) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(words)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, any_value(words) AS words FROM g GROUP BY 1) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
both_parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) ::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
