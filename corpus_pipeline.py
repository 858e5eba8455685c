"""A corpus pipeline over the documents table, from the operators of catalog_engine.llm.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
DataFrame; run() writes each result as Parquet in the shared folder and reads it back as the
next stage's docs. All stages but the last return the columns of documents.

Defined cases are those of the operators: null texts count as empty, rows that repeat an id
are judged by their own text, an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.llm import bpe, linededup, mixing, neardedup, toxicity
from catalog_engine.llm.common import stored, table

NEAR = neardedup.Settings(words=5, percent=80)
MIX_SHARE_PERCENT = 90

#: The stages cannot be put in SQL (a fitted model, sketches, BPE); tests hold them to brute force.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field predicts toxic go; it learns from labelled rows that aren't held out."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    cut = linededup.drop_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardedup.keep_one(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's share of the budget: 90 % of all tokens by target weights, one epoch at most."""
    return mixing.take(docs, share_percent=MIX_SHARE_PERCENT, max_epochs=1)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of every remaining document."""
    out = bpe.round_trip(docs, bpe.word_bpe(), keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", drop_template_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
