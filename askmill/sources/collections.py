"""Tables of collections: creating, and ingesting raw texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askmill.config import COLLECTION
from askmill.functions.hooks import embed
from askmill.operators.ingest import upsert_collection


def create_collection(spark: SparkSession, path: str, recreate: bool = False) -> DataFrame:
    """The empty table of a collection, if it isn't there or is to be made anew; else what is there."""
    empty = spark.createDataFrame([], COLLECTION)
    empty.write.mode("overwrite" if recreate else "ignore").parquet(path)
    return spark.read.schema(COLLECTION).parquet(path)


def ingest_texts(existing: DataFrame, texts: DataFrame, text: str = "document", keys: tuple[str, ...] = ("id",), **hook) -> DataFrame:
    """The collection with raw texts embedded and put in, without chunking."""
    return upsert_collection(existing, embed(texts, text, **hook), keys)
