"""Mixing sources to target weights with Pareto order sampling.

Every source gets a target in words: its weight's share of all words, but at most ``cap`` times what it
has; what a capped source leaves goes to the others by weight. A document is worth target / source words
expected copies. The whole part of that is certain for each document; the rest, the source's remaining
words, is drawn: each document has a random number U from its hash and is ranked by odds(U) / odds(p),
p its inclusion probability, and the lowest ranks are taken until the next would pass the remaining
words. The inclusion odds fall with the length of a text (``temper``), so that a few very long texts
don't decide a mix: odds(p) = c (1 + size)^-temper, with the c of a source solved so that its p times size add up
to the remaining words. One more document, whose size comes nearest to what is still missing, closes
the sample if that helps.

The decisions are thresholds per source on (rank, hash), so no task ever sorts a source: ranks are
counted in bins first, then only the bin that holds the threshold is ordered. A text and its exact
repeats with the same id are one unit and share their decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import free_names, materialize, others, quoted, table, word_count

BINS = 4096  # of ranks, for each source
BROADCAST_SOURCES = 20_000  # up to so many sources their table (some 100 bytes a source) is broadcast, beyond it is joined by a shuffle
SIZE_STEPS = 64  # to each doubling of a size, where the inclusion odds are solved


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, size) rows, one a source, to (source, source_size, weight, target).

    Sources stand in code point order, null last, and take the weights in turn. The capped ones are those
    whose cap is below their share once all sources with a lower cap per weight are capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * F.lit(cap)
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(by), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    c = w.withColumn("capped", limit <= share * F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), limit)).over(every), F.lit(0))) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    return c.select("source", "source_size", "weight", F.when(F.col("capped"), limit.cast("double")).otherwise(level * F.col("weight")).alias("target"))


def inclusion_levels(sizes: DataFrame, rest: DataFrame, temper: float) -> DataFrame:
    """(source, level): the c of each source for which the sum of size x p, p = c w / (1 + c w), w = (1 + size)^-temper, is its ``rest``.

    Sizes are gathered in steps of about one per cent, so that a source is some 2,000 numbers at most however
    many documents it has; c is then found by bisection of its logarithm."""
    steps = sizes.where("size > 0").groupBy("source", F.floor(F.log2(1.0 + F.col("size")) * SIZE_STEPS).alias("step")).agg(F.sum("size").cast("double").alias("words"), F.avg("size").alias("mean"))
    steps = steps.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("mean", "words"))).alias("steps"))
    both = steps.withColumnRenamed("source", "_s").join(rest, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")

    def halve(s, _):
        middle = (s["low"] + s["high"]) / 2
        taken = F.aggregate("steps", F.lit(0.0), lambda sum_, x: sum_ + x["words"] / (1 + F.exp(-middle) * F.pow(1 + x["mean"], F.lit(temper))))
        bounds = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
        return F.when(taken < F.col("rest"), bounds(middle, s["high"])).otherwise(bounds(s["low"], middle))

    start = F.struct(F.lit(-80.0).alias("low"), F.lit(80.0).alias("high"))
    level = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: F.exp(s["low"]))
    return both.select("source", F.when(F.col("rest") > 0, level).otherwise(0.0).alias("level"))


def inclusion(size: Column, level: Column, temper: float) -> Column:
    odds = level * F.pow(1.0 + size, F.lit(-temper))
    return F.when(size > 0, F.coalesce(odds / (1 + odds), F.lit(0.0))).otherwise(0.0)


def rank(unit: Column, p: Column) -> Column:
    """odds(U) / odds(p), mapped to (0, 1) in order; 1 where nothing is drawn."""
    u = (F.shiftrightunsigned(unit, 11).cast("double") + 0.5) / F.lit(2.0**53)
    return F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(1.0)


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), cap: int = 3, temper: float = 0.25, seed: int = 8) -> DataFrame:
    """Append size, source_size, target (double), inclusion (double, the probability of a copy beyond the certain
    ones), copies (int) and taken (copies x size) to every row.

    Null texts and texts without a word have size 0 and take no words; a null source is a source of its
    own. No document has more than ``cap`` copies. Repeated rows share a decision. Columns of the
    appended names, in any case, are replaced, all others pass through whatever their names. An empty table stays empty.
    """
    added = ["size", "source_size", "target", "inclusion", "copies", "taken"]
    base = docs.select(*others(docs, *added))
    size = word_count(docs[text_col])
    unit = F.xxhash64(F.lit(seed), docs[id_col].cast("string"), F.coalesce(docs[text_col], F.lit("")))
    own, law_ = free_names([*base.columns, *added], "own", "law")
    rows = docs.select(*others(docs, *added), F.struct(docs[source_col].alias("source"), size.alias("size"), unit.alias("unit")).alias(own))
    light = materialize(rows.select(f"{own}.*"))
    aim = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(copies + 1e-9)
    aim = materialize(aim.withColumn("certain", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))))
    small = aim.count() <= BROADCAST_SOURCES
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        r = near(right.withColumnRenamed("source", "_s"))
        return left.join(r, left["source"].eqNullSafe(r["_s"])).drop("_s")

    levels = materialize(inclusion_levels(light, aim.select("source", "rest"), temper))
    drawn = beside(light.where("size > 0"), levels).withColumn("at", rank(F.col("unit"), inclusion(F.col("size"), F.col("level"), temper))).drop("level")
    binned = drawn.withColumn("bin", F.floor(F.col("at") * BINS))
    run = Window.partitionBy("source").orderBy("bin")
    bins = beside(binned.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run)), aim.select("source", "rest"))
    edge = bins.where("upto > rest and upto - words <= rest").select("source", F.col("bin").alias("edge"), (F.col("upto") - F.col("words")).alias("below"), "rest")
    inside = beside(binned, edge).where("bin = edge").groupBy("source", "at", "unit").agg(F.sum("size").alias("words"), F.first("below").alias("below"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("at", "unit").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("upto", F.col("below") + F.sum("words").over(run)).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("at", "unit", "upto"))).alias("cut"), F.first("below").alias("below"), F.first("rest").alias("rest")
    )
    cuts = beside(edge.select("source", "edge"), fits).select(
        "source",
        F.coalesce(F.col("cut.at"), F.col("edge") / BINS).alias("cut_at"),
        F.coalesce(F.col("cut.unit"), F.lit(-(2**63))).alias("cut_unit"),
        (F.col("rest") - F.coalesce(F.col("cut.upto"), F.col("below"))).alias("missing"),
        F.col("cut").isNotNull().alias("has_cut"),
    )
    cuts = materialize(cuts)

    def below(at: Column, unit: Column, cut: Column) -> Column:
        return (at < cut["cut_at"]) | ((at == cut["cut_at"]) & cut["has_cut"] & (unit <= cut["cut_unit"]))

    cut = F.struct("cut_at", "cut_unit", "has_cut")
    left = beside(binned, cuts).where(~below(F.col("at"), F.col("unit"), cut)).groupBy("source", "unit", "at", "missing").agg(F.sum("size").alias("words"))
    closing = left.where("words < 2 * missing").groupBy("source").agg(F.min_by("unit", F.struct(F.abs(F.col("words") - F.col("missing")), "at", "unit")).alias("closer"))
    law = aim
    for d, name in ((levels, "_l"), (cuts, "_c"), (closing, "_x")):
        d = near(d.withColumnRenamed("source", name))
        law = law.join(d, law["source"].eqNullSafe(d[name]), "left").drop(name)
    law = materialize(law.select(F.struct("source", "source_size", "target", "certain", "rest", "level", cut.alias("cut"), "closer").alias(law_)))
    made = rows.join(near(law), F.col(f"{own}.source").eqNullSafe(F.col(f"{law_}.source")))
    size, unit, of = F.col(f"{own}.size"), F.col(f"{own}.unit"), F.col(law_)
    p = inclusion(size, of["level"], temper)
    every = of["cut"]["cut_at"].isNull() & (of["rest"] > 0)  # a rest that takes the whole source once
    hit = (size > 0) & F.coalesce(every | below(rank(unit, p), unit, of["cut"]) | (unit == of["closer"]), F.lit(False))
    copies = (of["certain"] + hit.cast("int")).cast("int")
    kept = [F.col(quoted(c)) for c in base.columns]
    return made.select(*kept, size.alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), p.alias("inclusion"), copies.alias("copies"), (copies * size).alias("taken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; see ``pareto_mix``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
