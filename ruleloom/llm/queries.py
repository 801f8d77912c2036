"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ruleloom.llm import decontaminate, language, licenses, line_dedup, lm, minhash, mixing, negatives, pieces, quality, suffix_dedup, toxicity, variants
from ruleloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark, folder):
    return decontaminate.report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op4_licenses(spark, folder):
    return licenses.report(read_table(spark, folder, "documents"))


@query
def op5_quality(spark, folder):
    return quality.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op10_mix(spark, folder):
    return mixing.report(read_table(spark, folder, "documents"))


@query
def op3_minhash(spark, folder):
    return minhash.report(read_table(spark, folder, "documents"))


@query
def op7_lm_score(spark, folder):
    return lm.report(read_table(spark, folder, "documents"))


@query
def op8_suffix_dedup(spark, folder):
    return suffix_dedup.report(read_table(spark, folder, "documents"))


@query
def op2_line_dedup(spark, folder):
    return line_dedup.report(read_table(spark, folder, "documents"))


@query
def op6_language(spark, folder):
    return language.report(read_table(spark, folder, "documents"))


@query
def op9_toxicity(spark, folder):
    return toxicity.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op11_sentencepiece(spark, folder):
    return pieces.report(read_table(spark, folder, "documents"), pieces.model_path(spark, "piece_bpe_32k.model"))


@query
def op12_hard_negatives(spark, folder):
    return negatives.report(read_table(spark, folder, "embeddings"))


@query
def op13_spelling_variants(spark, folder):
    return variants.report(read_table(spark, folder, "documents"))
