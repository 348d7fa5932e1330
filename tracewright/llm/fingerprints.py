"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A shingle is five consecutive words (a text of fewer words is one shingle of all of them); a sketch is
the ascending array of the k smallest distinct shingle hashes. Sketches of parts merge to the sketch of
the union, and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, table

K = 128
WIDTH = 5


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles of a text, in order, with repeats; empty for null or no word."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

    def windows(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        )

    # inside transform(array(x), ...) the word hashes are computed once, not once a shingle
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), windows), F.lit(0))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches were made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact while the union has at most k shingles. Two empty sketches: 1."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else from how low the k-th smallest hash is."""
    low = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / low)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the shared part of the union over the size of a."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def text_of(a: Column) -> Column:
    return F.concat_ws(",", F.transform(a, lambda x: F.lower(F.hex(x))))


def merged_sketches(df: DataFrame, group_cols: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch a group, without ever holding more than k hashes of a group times the partial results:
    hashes are made distinct first, then the k smallest of each group are kept by a limited window."""
    each = df.select(*group_cols, F.explode(sketch_col).alias("h")).distinct()
    low = each.withColumn("n", F.row_number().over(Window.partitionBy(*group_cols).orderBy("h"))).where(F.col("n") <= k)
    return low.groupBy(*group_cols).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def successors(rows: DataFrame) -> DataFrame:
    """For rows of (id, key, th, n, times), distinct by key and th: the (key, th) that follows in descending key order, the last one followed by the first.

    Range partitioning cuts the order (id descending, null last, then text hash) into bins, also inside a
    frequent id or among null ones; a window finds the successor inside a bin, and the first row of the next
    bin follows the last of a bin. Only the first rows of the bins meet in one task. The bins are written
    before they are used, so that a lost task finds the same ones.
    """
    place = [F.col("id").desc_nulls_last(), F.col("th")]
    binned = materialize(rows.repartitionByRange(*place).withColumn("bin", F.spark_partition_id()))
    order = Window.partitionBy("bin").orderBy(*place)
    own = F.struct("key", "th")
    linked = binned.withColumn("next", F.lead(own).over(order)).withColumn("first", F.row_number().over(order) == 1)
    heads = linked.where("first").select("bin", own.alias("head"))
    ring = Window.orderBy("bin")  # a row for each bin
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("bin", F.coalesce(F.lead("head").over(ring), F.first("head").over(every)).alias("after"))
    return linked.join(F.broadcast(follow), "bin").select("key", "th", "n", "times", F.coalesce("next", "after").alias("next"))


def distinct_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``with_next_text``, equal ones once with their number in ``repeats``. A document's sketch is
    made before its text is shuffled, and handed on."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(0))).withColumn("th", F.xxhash64(F.col("id").isNull(), "text"))
    counted = rows.select("id", "key", "th", F.length("text").cast("long").alias("n")).groupBy("key", "th").agg(F.first("id").alias("id"), F.count("*").alias("times"), F.first("n").alias("n"))
    after = successors(counted)
    # what each document must hand to the one before it, and to which
    asked = after.select(F.col("next.key").alias("nkey"), F.col("next.th").alias("nth"), F.col("key").alias("tkey"), F.col("th").alias("tth"), F.floor(F.col("n") / 3).cast("int").alias("need"), "times")
    once = rows.withColumn("sketch", sketch(F.col("text"))).dropDuplicates(["key", "th"])
    hand = once.join(asked, (F.col("key") == F.col("nkey")) & (F.col("th") == F.col("nth")))
    hand = hand.select("tkey", "tth", "times", F.expr("substring(text, 1, need)").alias("start"), F.col("sketch").alias("next_sketch"), F.col("id").alias("next_id"))
    both = once.join(hand, (F.col("key") == F.col("tkey")) & (F.col("th") == F.col("tth")))
    # a repeated row is followed by itself, all but the last time
    own = F.struct((F.col("times") - 1).alias("repeats"), F.expr("substring(text, 1, cast(floor(length(text) / 3) as int))").alias("start"), F.col("sketch").alias("next_sketch"), F.col("id").alias("next_id"))
    last = F.struct(F.lit(1).cast("bigint").alias("repeats"), "start", "next_sketch", "next_id")
    ways = both.select("id", "text", "sketch", F.explode(F.when(F.col("times") > 1, F.array(own, last)).otherwise(F.array(last))).alias("way"))
    kept = F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 3) as int))")
    return ways.select("id", "text", "sketch", F.concat(kept, "way.start").alias("edited"), "way.next_id", "way.next_sketch", "way.repeats")


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``repeats`` says, without that column."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats")))).drop("_copy", "repeats")


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sketch, edited, next_id, next_sketch) of every row: the text, its sketch, the text with its last
    third replaced, and the sketch of the document that follows in descending id order.

    Null text counts as empty. Of rows with one id the text hash decides the order, and repeated rows follow one
    another; a single document follows itself. Null ids come last.
    """
    return repeated(distinct_with_next(docs, id_col, text_col))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness; see ``with_next_text`` for null
    texts and ids, ties and repeated rows. Beside the columns of the contract: distinct_shingles, kept_in_edited
    (containment of the document in its edited text) and next_doc_id."""
    made = distinct_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("sketch").alias("a"), sketch(F.col("edited")).alias("b"), "next_id", "next_sketch", "repeats")
    made = made.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text_of(F.col("a")).alias("fingerprint"),
        text_of(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b")).alias("near_edited"),
        resemblance(F.col("a"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("a")).alias("distinct_shingles"),
        containment(F.col("a"), F.col("b")).alias("kept_in_edited"),
        F.col("next_id").alias("next_doc_id"),
        "repeats",
    )
    return repeated(made)  # what equal rows share is computed once
