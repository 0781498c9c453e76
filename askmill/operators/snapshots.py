"""Retention, choice and recovery of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_times(catalog: DataFrame) -> DataFrame:
    """Adds created_at: wall-clock time without a zone; null where the text is no time."""
    return catalog.withColumn("created_at", F.expr("try_cast(creation_time as timestamp_ntz)"))


def old_snapshots(catalog: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Snapshots made before ``now`` less ``days``, strictly. Times that can't be read never are."""
    return parse_times(catalog).filter(F.col("created_at") < F.expr(f"timestamp_ntz'{now}' - interval {days} days")).drop("created_at")


def due_collections(collections: DataFrame, catalog: DataFrame, now: str) -> DataFrame:
    """Collections without a snapshot of today."""
    today = parse_times(catalog).filter(F.to_date("created_at") == F.lit(now[:10]).cast("date")).select("collection").distinct()
    return collections.select("collection").distinct().join(today, "collection", "left_anti")


def latest_snapshots(catalog: DataFrame) -> DataFrame:
    """collection, name of its newest snapshot; of equal times, the last name."""
    read = parse_times(catalog).filter("created_at is not null")
    return read.groupBy("collection").agg(F.max_by("name", F.struct("created_at", "name")).alias("name"))


def select_snapshots(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """collection, name, status for each wanted collection that exists: the named snapshot, or the newest; ``missing`` if there is none of that name."""
    known = catalog.select("collection", F.col("name").alias("found")).distinct()
    exists = wanted.join(catalog.select("collection").distinct(), "collection", "left_semi")
    named = exists.filter("name is not null").join(known, (exists["collection"] == known["collection"]) & (exists["name"] == known["found"]), "left").select(exists["collection"], exists["name"], F.when(F.col("found").isNull(), "missing").otherwise("ok").alias("status"))
    newest = exists.filter("name is null").select("collection").join(latest_snapshots(catalog), "collection", "left")
    return named.unionByName(newest.select("collection", "name", F.when(F.col("name").isNull(), "missing").otherwise("ok").alias("status")))


def write_snapshot(collection: DataFrame, folder: str, name: str) -> str:
    """A full copy of the collections under a dated name, a folder each."""
    collection.write.mode("errorifexists").partitionBy("collection").parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def snapshots_below(spark: SparkSession, folder: str) -> DataFrame:
    """collection, name, creation_time of all snapshots that lie below ``folder``, from the names of their files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "modificationTime")
    part = lambda k: F.url_decode(F.regexp_extract("path", r"/([^/]+)/collection=([^/]+)/[^/]+$", k))
    rows = files.select(part(2).alias("collection"), part(1).alias("name"), "modificationTime").filter("name <> ''")
    return rows.groupBy("collection", "name").agg(F.date_format(F.max("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss").alias("creation_time"))


def recover(spark: SparkSession, chosen: DataFrame, folder: str) -> DataFrame:
    """The rows of the chosen snapshots, each with its collection; columns that a snapshot lacks are null. One scan reads the chosen folders, however many, and no others.

    ``chosen`` has a row for each collection, and what it names is listed by the driver in any case.
    """
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    found = chosen.filter("status = 'ok'").select("collection", "name").distinct().collect()
    if not found:
        raise ValueError("no snapshot to recover")
    paths = [f"{folder}/{r.name}/collection={'__HIVE_DEFAULT_PARTITION__' if r.collection is None else escape(r.collection)}" for r in found]
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(*sorted(paths))
    value = F.regexp_extract(F.col("_metadata.file_path"), r"/collection=([^/]+)/[^/]+$", 1)
    # The path is a URL of a name that is escaped already.
    return rows.select("*", F.when(value != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.url_decode(F.replace(value, F.lit("+"), F.lit("%252B"))))).alias("collection"))


def restore(spark: SparkSession, chosen: DataFrame, folder: str, target: str) -> DataFrame:
    """Puts the chosen snapshots in place of their collections in the table below ``target``; its other collections stay. Gives the table."""
    rows = recover(spark, chosen, folder)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(target)
    return spark.read.parquet(target)
