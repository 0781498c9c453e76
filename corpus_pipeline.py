"""A corpus from documents to packed sequences: each stage works on what the one before has kept, written as Parquet between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.llm import language, minhash, mixing, packing, quality
from askmill.llm.common import cut, table

#: Of the way from even shares to certainty, how far a document's language must come. Clean text is above that; even mixtures
#: and long noise are mostly not. Short noise can pass: a softmax over languages has no class for what is none of them.
LEAST_WAY = 0.4


def least_score(languages: int) -> float:
    """The least probability of a document's language among so many: 0.55 of four, 0.7 of two; of one nothing can be told."""
    return (1 + LEAST_WAY * (languages - 1)) / languages if languages else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; null, empty and letterless texts go. What is told is their ``lang`` from here on; other columns stay as they are."""
    net = language.fit(docs)
    found = language.identify(docs, net, lang="__lang", score="__score")
    least = least_score(len(net.languages) if net else 0)
    return found.filter((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= least)).withColumn("lang", F.col("__lang")).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the base rules and lie near their language's references, which are made from ``docs`` themselves."""
    return quality.select_kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: shingles of five words, similarity 0.8 or more."""
    return minhash.keep_one(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; one that it takes two or three times has as many rows."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces; a repeated document is packed as often as it comes."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Language, quality and near-duplicate stages are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
