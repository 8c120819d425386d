"""A corpus pipeline: each stage takes the documents its predecessor kept and gives those it keeps.

`run` applies the stages to the documents table; each stage's rows are written as Parquet and read again.  Every stage but
the last gives the columns of documents.

Decisions hold for an id and a text together, so that texts with the same id, or with none, are judged apart.  Rows that
repeat both are kept or left out alike by the first two stages; the third keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelforge.llm import language_id, line_dedup, mixture, ngram_join, piece_encoding
from parcelforge.llm.common import removed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents go whose words are labelled with a smaller probability on average, whatever language each of them is in.
LEAST_SURE = 0.4


def row_key() -> Column:
    """Of an id and a text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, or in several: those without letters, and those in which no language is recognised, go."""
    return language_id.recognised(docs.select(*COLUMNS), language_id.train(docs), LEAST_SURE)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; documents of such lines alone go."""
    return line_dedup.without_lines(docs).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; a null id comes last."""
    keyed = docs.withColumn("key", row_key())
    found = ngram_join.jaccard_components(keyed, id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = found.join(keyed.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(F.min(order).alias("first")).select("first.key")
    copies = Window.partitionBy("key").orderBy("source", "lang", "n_chars")
    return keyed.join(kept, "key", "left_semi").withColumn("copy", F.row_number().over(copies)).where("copy = 1").select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: documents as often as they are taken, one of them in part where the mix takes a part."""
    return mixture.mixed_documents(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of the mix."""
    return piece_encoding.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", distinct_lines),
    ("ngram_join", distinct_texts),
    ("mixture", mixed_sources),
    ("sentencepiece", encoded),
]

#: SQL can't express the first stage, whose model is fitted, nor the segmentation of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            removed(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
