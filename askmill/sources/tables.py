"""Reading the given tables and, from them, what stands for files, collections, questions, caches, session logs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators.dense import unit

COLLECTION = "docs"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """path, text of each file below ``path`` (text), or the rows of a table (parquet, json, csv)."""
    if fmt == "text":
        return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return spark.read.format(fmt).load(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of the files below ``root``; their contents aren't read. Spark gives empty files no row: they have nothing to ingest."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ".doc", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("/docs/"), "doc_id", F.lit(".pdf"))).otherwise(F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", ext))
    return docs.select("doc_id", "lang", path.alias("path"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks a third of the files and holds chunks of files that are gone."""
    from askmill.operators.ingest import filter_formats, with_collection

    all_files = files(spark, sf_dir)
    known = with_collection(filter_formats(all_files), "/docs").filter("doc_id % 3 <> 0").select("doc_id", "collection", F.col("path").alias("file_path"))
    gone = all_files.filter("doc_id % 10 = 0").select("doc_id", F.col("lang").alias("collection"), F.concat(F.lit("/docs/"), "lang", F.lit("/gone/"), "doc_id", F.lit(".pdf")).alias("file_path"))
    rows = known.unionByName(gone)
    return rows.select("collection", "file_path", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("chunk_index"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, id, text, document, file_path, display_docs, rating, rating_count, payload, dense: all documents, with a vector where one of their id is there. Some payload keys are null."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    paths = F.concat(F.lit("/docs/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), "doc_id")
    some = lambda n, x: F.when(F.col("doc_id") % n != 0, x)
    return docs.join(vectors, "doc_id", "left").select(
        F.lit(COLLECTION).alias("collection"), F.col("doc_id").cast("string").alias("id"), "text", F.col("text").alias("document"), some(7, paths).alias("file_path"),
        some(2, F.concat(F.lit("see "), "doc_id")).alias("display_docs"), some(3, 1.0 + F.col("doc_id") % 5).alias("rating"), some(3, F.col("doc_id") % 4).alias("rating_count"),
        F.create_map(F.lit("source"), F.col("source")).alias("payload"), "dense",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, query_id, text, qvec: a question from every document whose id is divisible by 100, of its whole text."""
    rows = corpus(spark, sf_dir).filter(F.col("id").cast("long") % 100 == 0)
    return rows.select("collection", F.col("id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("dense").alias("qvec"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("vectors").alias("collection"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("dense"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("id").cast("long") % 100 == 0).select("collection", F.col("id").alias("query_id"), F.col("dense").alias("qvec"))


def late(rows: DataFrame, vector: str, out: str, parts: int = 8) -> DataFrame:
    """Adds a vector cut into ``parts`` of equal length, each of unit length; null for a null vector, or one whose length isn't a multiple of ``parts``."""
    step = (F.size(vector) / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(F.col(vector), k * step + 1, step))
    return rows.withColumn(out, F.when(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.transform(cut, unit)))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    name = F.col("vec_id").cast("string")
    return rows.select(
        F.lit("vectors").alias("collection"), name.alias("question_id"), F.col("embedding").alias("dense"), F.concat(F.lit("question "), name).alias("question"), F.concat(F.lit("answer "), name).alias("answer"),
        F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("/docs/"), name)).alias("display_docs"), (1.0 + F.floor(F.col("vec_id") / 10) % 5).alias("rating"), (1 + F.col("vec_id") % 5).alias("rating_count"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session log from all events: the question is the event's k, none for a sign-up; one entry of seven has no rating."""
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return rows.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") != "signup", k).alias("question_id"),
        F.concat_ws("", "event_type", k).alias("msg"),
        F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/docs/"), k)).alias("display_docs"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") % 6).alias("rating"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache before a flush: a row for each question below 80 that the log names."""
    ids = ratings(spark, sf_dir).filter("question_id is not null").select(F.col("question_id").cast("long").alias("q")).distinct().filter("q < 80")
    name = F.col("q").cast("string")
    return ids.select(name.alias("question_id"), F.concat(F.lit("question "), name).alias("question"), F.concat(F.lit("old answer "), name).alias("answer"), F.lit(None).cast("string").alias("display_docs"), (3.0 + F.col("q") % 3).alias("rating"), (1 + F.col("q") % 5).alias("rating_count"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = (F.col("role") == "user") & (F.col("conv_id") % 7 == 0) & (F.col("turn") % 4 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(blank, "  \n ").otherwise(F.col("text")).alias("text"))


def cleared_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns, of which one user's turn of five clears the dialogue."""
    from askmill.operators.chat import CLEAR

    clears = (F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    return turns(spark, sf_dir).withColumn("text", F.when(clears, CLEAR).otherwise(F.col("text")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(F.col("o_orderkey") % 101 == 0, "bad").when(F.col("o_orderkey") % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso)
    return rows.select(F.col("o_orderpriority").alias("collection"), F.concat(F.lit("snap-"), "o_orderkey").alias("name"), time.alias("creation_time"))
