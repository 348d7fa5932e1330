"""Known names inside texts, without comparing each text with each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.names import shared_service

# fixed values: labels that may tell a service, in this order
SERVICE_LABELS = ["service", "app", "app.kubernetes.io/name", "workload", "container", "pod", "pod_name", "service_name", "destination_service", "source_service"]
GRAM = 4


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters; a shorter text has none."""
    n = F.char_length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def longest_known(texts: DataFrame, known: DataFrame, scope: list[str], text_col: str = "text", name_col: str = "name") -> DataFrame:
    """``texts`` with ``match``, the longest known name of the same scope that stands anywhere in the text, of equally long
    ones the smallest; null without one.

    Of each name its rarest piece of four characters among the names of its scope (a shorter name is its own piece) is the key
    under which distinct texts and names meet in an equality join; what meets is then verified. Null and empty texts and
    names match nothing. Repeated texts count once until the result is joined back.
    """
    names = known.select(*scope, F.col(name_col).alias("name")).where("name <> ''").distinct()
    pieces = names.select(*scope, "name", F.explode(F.when(F.char_length("name") < GRAM, F.array("name")).otherwise(_grams(F.col("name"), GRAM))).alias("gram"))
    common = pieces.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    keyed = pieces.join(common, [*scope, "gram"]).groupBy(*scope, "name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    own = texts.select(*scope, F.col(text_col).alias("text")).where("text <> ''").distinct()
    every = F.array_distinct(F.concat(*[_grams(F.col("text"), k) for k in range(1, GRAM + 1)]))
    met = own.select(*scope, "text", F.explode(every).alias("gram")).join(keyed, [*scope, "gram"]).where(F.contains(F.col("text"), F.col("name")))
    best = met.groupBy(*scope, "text").agg(F.min_by("name", F.struct(-F.char_length("name"), "name")).alias("match"))
    return texts.join(best.withColumnRenamed("text", text_col), [*scope, text_col], "left")


def label_values(labels: Column) -> Column:
    """Of a map of labels the values that may tell a service, in order, without blanks."""
    each = F.array(*[F.try_element_at(labels, F.lit(k)) for k in SERVICE_LABELS])
    return F.filter(each, lambda v: v.isNotNull() & (v != ""))


def service_of_labels(rows: DataFrame, known: DataFrame, scope: list[str], labels_col: str = "labels") -> DataFrame:
    """``rows`` with ``service``: the longest known name in the labels' values, else the first value as a name, else null."""
    told = rows.withColumn("text", F.array_join(label_values(F.col(labels_col)), " "))
    made = longest_known(told, known, scope)
    first = F.get(label_values(F.col(labels_col)), F.lit(0))
    return made.withColumn("service", F.coalesce("match", F.when(first.isNotNull(), shared_service(first)))).drop("text", "match")
