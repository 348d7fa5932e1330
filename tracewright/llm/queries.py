"""The registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import (
    fingerprints,
    langid_ppm,
    license_rules,
    line_runs,
    merkle_manifest,
    ngram_join,
    sentencepiece_codec,
    shard_shuffle,
    source_divergence,
    source_mix,
    toxicity_pu,
    vptree,
    warc_fixity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
        "op2_warc_fixity": warc_fixity.op2_warc_fixity,
        "op3_toxicity": toxicity_pu.op3_toxicity,
        "op4_fingerprint": fingerprints.op4_fingerprint,
        "op5_vptree": vptree.op5_vptree,
        "op6_shard_shuffle": shard_shuffle.op6_shard_shuffle,
        "op7_licenses": license_rules.op7_licenses,
        "op8_source_mix": source_mix.op8_source_mix,
        "op9_language_id": langid_ppm.op9_language_id,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
        "op13_line_dedup": line_runs.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_fixity": warc_fixity.ORACLE,
        "op10_ngram_join": ngram_join.ORACLE,
        "op11_source_divergence": source_divergence.ORACLE,
        "op12_merkle_manifest": merkle_manifest.ORACLE,
        "op13_line_dedup": line_runs.ORACLE,
    }
