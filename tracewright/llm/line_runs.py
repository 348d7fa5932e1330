"""Lines that many documents share stay in one document only.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased, its hash 128 bits of it.
First all long keys are counted: how many documents hold each. Of those that enough documents hold, the
occurrences are written in batches, newest documents first. The hashes that earlier batches have met lie in sorted
runs in levels: a batch is merge-anti-joined with each run, so that only hashes new to all of them are left, and these,
with the document that keeps the line, become a run of level 0. A level with ``fanout`` runs is compacted into one run of
the next level, so a batch meets few runs, and a hash is rewritten once a level. Runs are bucketed and sorted by hash: a
join doesn't shuffle them. Only hashes travel, and each text once, to the join with what it loses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import free_names, others, quoted, shared_folder, table, written

BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BATCHES = 8
FANOUT = 4
HASH = ["h1", "h2"]


def _once(x: Column, f) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def lines(text: Column) -> Column:
    """The text cut at line feeds; null and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(key: Column) -> list[Column]:
    """Two hashes of 64 bits with different seeds."""
    return [F.xxhash64(key).alias(HASH[0]), F.xxhash64(F.lit(13), key).alias(HASH[1])]


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, h1, h2) of the distinct long keys of each row of (id, text)."""
    keys = F.filter(F.transform(lines(F.col("text")), line_key), lambda k: F.char_length(k) >= least_chars)
    return docs.select("id", F.explode(F.array_distinct(keys)).alias("key")).select("id", *_hash(F.col("key")))


class LevelledRuns:
    """Hashes met so far, with what was said of each when it was met first."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add the rows of a batch, one a hash, whose hashes no run holds."""
        for run in self.runs():
            batch = batch.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        self._push(0, _run(batch))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = _union(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, _run(merged.repartition(_buckets(merged.sparkSession), *HASH)))

    def met(self) -> DataFrame:
        """All rows; no two have one hash."""
        return _union(self.runs())


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _run(rows: DataFrame) -> DataFrame:
    """The rows, written in buckets by hash and sorted inside them. The catalog forgets the table at once, its files stay."""
    spark, name = rows.sparkSession, f"line_run_{uuid.uuid4().hex}"
    rows.write.bucketBy(_buckets(spark), *HASH).sortBy(*HASH).option("path", shared_folder(spark)).saveAsTable(name)
    run = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return run


def keepers(docs: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """From (id, text): (id, batch, h1, h2), where shared lines stand, and (h1, h2, keeper), the largest id that holds each."""
    held = written(occurrences(docs, least_chars))
    # written before it is joined, so that Spark can split the rows of a very common line
    shared = written(held.groupBy(*HASH).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select(*HASH))
    cuts = sorted(set(docs.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)))  # few numbers, whatever the table
    above = [F.when(F.col("id") < F.lit(c), 1).otherwise(0) for c in cuts]
    batch = F.when(F.col("id").isNull(), len(cuts)).otherwise(sum(above, F.lit(0))).cast("int")
    placed = written(held.join(shared, HASH, "left_semi").select("id", *HASH, batch.alias("batch")), "batch")
    met = LevelledRuns(fanout)
    for k in range(len(cuts) + 1):  # the largest ids first
        met.add(placed.where(F.col("batch") == k).groupBy(*HASH).agg(F.max("id").alias("keeper")))
    return placed, met.met()


def _found(sorted_hashes: Column, h: Column) -> Column:
    """Whether the sorted array holds h, by halving."""

    def search(a: Column) -> Column:
        bits = F.sequence(F.length(F.bin(F.size(a))) - 1, F.lit(0), F.lit(-1))
        low = F.aggregate(bits, F.lit(0), lambda at, b: F.when(F.get(a, at + _power(b) - 1) < h, at + _power(b)).otherwise(at))
        return F.coalesce(F.get(a, low) == h, F.lit(False))

    return _once(sorted_hashes, search)


def _power(b: Column) -> Column:
    return F.pow(F.lit(2), b).cast("int")


def drop_shared_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """Append n_lines and n_dropped (long) and kept (string), the lines left of each text, joined by line feeds.

    A line goes if its key has ``least_chars`` code points or more, ``least_docs`` rows or more hold it, and the row's
    id isn't the largest of theirs. Every row is a document: repeated rows count each, and rows that share the largest id
    all keep the line. A null id is less than any other. A null text counts as empty; a text of which no line is left is
    empty. Columns named as appended ones, in any case, are replaced, all others pass through. An empty table stays empty.
    Ids are whole numbers.
    """
    base = df.select(*others(df, "n_lines", "n_dropped", "kept"))
    docs = base.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    placed, kept_by = keepers(docs, least_chars, least_docs, batches, fanout)
    lost = placed.join(kept_by, HASH).where(~F.col("id").eqNullSafe(F.col("keeper")))
    key, drops = free_names([*base.columns, "n_lines", "n_dropped", "kept"], "key", "drops")
    lost = lost.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*HASH))).alias(drops)).withColumnRenamed("id", key)
    own = F.col(quoted(id_col)).cast("long")
    joined = base.join(lost, own.eqNullSafe(F.col(key)), "left")

    def stays(line: Column) -> Column:
        return _once(line_key(line), lambda k: (F.char_length(k) < least_chars) | ~_found(F.col(drops), F.struct(*_hash(k))))

    each = lines(F.col(quoted(text_col)))
    left = F.when(F.col(drops).isNull(), each).otherwise(F.filter(each, stays))
    made = joined.withColumn(drops, left)
    n = F.size(each).cast("long")
    cut = (n - F.size(drops)).alias("n_dropped")
    return made.select(*[F.col(quoted(c)) for c in base.columns], n.alias("n_lines"), cut, F.array_join(drops, "\n").alias("kept"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document, see ``drop_shared_lines``."""
    made = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.r, k.doc_id, k.no, k.line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
