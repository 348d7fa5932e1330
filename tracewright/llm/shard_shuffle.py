"""A uniform shuffle into shards of exact size.

Rows are spread over virtual partitions by hash. For these a communication matrix is drawn: how many of
a partition's rows go to each shard, from the multivariate hypergeometric law that a uniform permutation
of all rows would give, with the row sums (partition sizes) and column sums (shard sizes) exact. Each
partition permutes its rows by a random key and deals them out by its row of the matrix, rows are
exchanged, and each shard permutes what it received by a second key. Sizes are exact, and given the
random keys every assignment is equally likely. Keys are hashes of the row, so a repeated or partly lost
run deals the same way.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import free_names, materialize, others, quoted, table

LEAST_PARTITIONS = 256
ROWS_IN_PARTITION = 50_000  # ordered in one task; the matrix has a row for each partition, 20,000 for a billion rows
ROWS_IN_BIN = 500
HOT_ROWS = 5_000  # equal rows whose hashes are salted


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good; by inversion outwards from the mode."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = up = down = math.exp(log(good, mode) + log(bad, drawn - mode) - log(good + bad, drawn))
    u = rng.random() - p
    a = b = mode
    while u > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (drawn - b) / ((b + 1) * (bad - drawn + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            down *= a * (bad - drawn + a) / ((good - a + 1) * (drawn - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random table with these row and column sums, as a uniform permutation would fill it."""
    rng, left, matrix = random.Random(seed), list(columns), []
    for n in rows:
        line, rest, total = [], n, sum(left)
        for j, free in enumerate(left):
            x = hypergeometric(rng, free, total - free, rest)
            line.append(x)
            total -= free
            rest -= x
            left[j] -= x
        matrix.append(line)
    return matrix


def shuffle_into_shards(df: DataFrame, key_cols: list[str], shards: int = 16, seed: int = 6) -> DataFrame:
    """Append shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Shard sizes are at most one apart. Rows are told apart by ``key_cols`` (nulls count as a value); rows
    that agree in all of them are interchangeable, and if more than HOT_ROWS agree, their hashes are salted with their number
    in the table, which is then written once so that a rerun of a task finds the same numbers. Columns named shard or slot, in any case, are replaced, all
    others pass through whatever their names. With fewer rows than shards some shards stay empty; an empty table stays empty.
    """
    base = df.select(*others(df, "shard", "slot"))
    m, q, cut = free_names([*base.columns, "shard", "slot"], "m", "q", "cut")
    key = F.xxhash64(F.lit(seed), *[x for c in key_cols for x in (F.col(quoted(c)).isNull(), F.col(quoted(c)))])
    hashed_rows = base.withColumn(m, key)
    # the hashes of rows that agree too often: fewer than one for each HOT_ROWS rows of the input
    hot = materialize(hashed_rows.groupBy(m).count().where(F.col("count") > HOT_ROWS).select(F.col(m).alias(cut)))
    if not hot.isEmpty():
        numbered = materialize(hashed_rows).withColumn(q, F.monotonically_increasing_id())
        salted = F.when(F.col(cut).isNull(), F.col(m)).otherwise(F.xxhash64(m, q))
        hashed_rows = numbered.join(F.broadcast(hot), F.col(m) == F.col(cut), "left").withColumn(m, salted).drop(q, cut)
    hashed = F.transform(F.array(F.col(m)), lambda u: F.struct(u.alias("unit"), F.xxhash64(F.lit(seed + 1), u).alias("first"), F.xxhash64(F.lit(seed + 2), u).alias("second")))
    keyed = hashed_rows.withColumn(m, F.get(hashed, F.lit(0)))
    n = base.count()
    parts = max(LEAST_PARTITIONS, math.ceil(n / ROWS_IN_PARTITION))
    keyed = keyed.withColumn(q, F.pmod(F.col(f"{m}.unit"), F.lit(parts)).cast("int"))
    counted = {r[q]: r["count"] for r in keyed.groupBy(q).count().collect()}  # a number for each partition
    total = sum(counted.values())
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], sizes, seed)
    cuts = json.dumps([list(accumulate(line)) for line in matrix])
    dealt = df.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(cuts), "array<array<bigint>>")).alias(q, cut))
    place = F.row_number().over(Window.partitionBy(q).orderBy(f"{m}.first", f"{m}.unit"))
    ranked = keyed.withColumn(m, F.struct(f"{m}.unit", f"{m}.second", place.alias("place"))).join(F.broadcast(dealt), q)
    bins = max(1, math.ceil(total / shards / ROWS_IN_BIN))
    sent = ranked.withColumn("shard", F.size(F.filter(cut, lambda c: c < F.col(f"{m}.place"))).cast("int"))
    sent = materialize(sent.withColumn(q, F.pmod(F.col(f"{m}.second"), F.lit(bins))).drop(cut))
    upto = Window.partitionBy("shard").orderBy(q).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", q).agg(F.count("*").alias(cut)).select("shard", q, F.coalesce(F.sum(cut).over(upto), F.lit(0)).alias(cut))
    slot = F.row_number().over(Window.partitionBy("shard", q).orderBy(f"{m}.second", f"{m}.unit")).cast("long") - 1
    kept = [F.col(quoted(c)) for c in base.columns]
    return sent.withColumn("slot", slot).join(offsets, ["shard", q]).select(*kept, "shard", (F.col("slot") + F.col(cut)).alias("slot"))


def op6_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, dealt by ``shuffle_into_shards``
    under the law ``rows``; a null text has size 1 and the crc of no byte."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = shuffle_into_shards(materialize(docs), ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
