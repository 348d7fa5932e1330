"""From raw documents to token ids: five stages, each one operator of tracewright.llm.

``run`` applies them to ``documents``. Every stage works on all that its predecessor kept, and all but
the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import langid_ppm, ngram_join, sentencepiece_codec, source_mix, toxicity_pu
from tracewright.llm.common import free_names, materialize, quoted, table


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """The table with the columns that bear a name that an operator appends, in any case, under another one; and
    the expressions that give the columns of ``docs`` again."""
    moved = [c for c in docs.columns if c.lower() in names]
    other = dict(zip(moved, free_names([*docs.columns, *names], *[f"kept_{k}" for k in range(len(moved))])))
    own = docs.select(*[F.col(quoted(c)).alias(other.get(c, c)) for c in docs.columns])
    return own, [F.col(quoted(other.get(c, c))).alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from all labels there are."""
    model = toxicity_pu.learn(docs, table(spark, sf_dir, "labels"))
    own, back = _aside(docs, ["score", "predicted"])
    return toxicity_pu.score(own, model).where("predicted = 0").select(*back)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language: those without a letter go, and those which the best
    language's code doesn't make shorter than their bytes."""
    own, back = _aside(docs, ["lang_pred", "score", "bits_per_byte"])
    made = langid_ppm.identify(own, langid_ppm.learn(docs))
    return made.where((F.col("lang_pred") != langid_ppm.UNDETERMINED) & (F.col("bits_per_byte") < 8)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    own, back = _aside(docs, ["size", "source_size", "target", "inclusion", "copies", "taken"])
    made = source_mix.pareto_mix(own).where("copies > 0")
    copy = free_names(made.columns, "copy")[0]
    return made.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row."""
    coded = sentencepiece_codec.encode_decode(docs.select("doc_id", "source", "text"), sentencepiece_codec.default_model())
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None  # no stage but the third can be put in SQL; tests/llm hold them against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
