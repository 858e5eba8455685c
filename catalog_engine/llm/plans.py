"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from catalog_engine.llm import (bpe, divergence, filter_audit, fingerprints, languages, linededup, lm, mixing, neardedup, quality, token_files,
                                topk_search, toxicity)
from catalog_engine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.digests(table(spark, sf_dir, "documents"))


@query
def op2_bpe_round_trip(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.word_bpe())


@query
def op3_minhash_near_dedup(spark, sf_dir):
    return neardedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), bpe.word_bpe())


@query
def op5_line_dedup(spark, sf_dir):
    return linededup.dedup(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


ORACLES["op6_quality_rules"] = quality.oracle()


@query
def op7_language_id(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents"))


@query
def op8_source_mixing(spark, sf_dir):
    return mixing.selection(table(spark, sf_dir, "documents"))


ORACLES["op8_source_mixing"] = mixing.oracle()


@query
def op9_toxicity(spark, sf_dir):
    return toxicity.tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_lm_scoring(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"), order=3)


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filter_audit.oracle()


@query
def op12_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op12_topk_search"] = topk_search.oracle()


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = divergence.oracle()


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
