"""Folders against the index: listing, syncing, upserting and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The formats that are read. Compared in small letters, with their dot.
FORMATS = (".pdf", ".doc", ".docx")
#: Collections that one observation counts apart.
MOST_COLLECTIONS = 1000


def with_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("suffix", F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def filter_formats(files: DataFrame, allowed: tuple[str, ...] = FORMATS, path: str = "path", strict_suffix: bool = False) -> DataFrame:
    """Files of the allowed formats; all if none is named. ``strict_suffix`` compares formats as they are written."""
    if not allowed:
        return files
    wanted = allowed if strict_suffix else tuple("." + x.lower().lstrip(".") for x in allowed)
    return with_suffix(files, path).filter(F.col("suffix").isin(*wanted))


def with_collection(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Adds collection, the first folder below ``root``; files in the root itself go."""
    below = F.substring(F.col(path), len(root.rstrip("/")) + 2, 1 << 30)
    parts = F.split(below, "/")
    return files.filter(F.col(path).startswith(root.rstrip("/") + "/") & (F.size(parts) > 1)).withColumn("collection", parts[0])


def sync(files: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """new files, orphaned chunks and surviving chunks. ``files``: collection, path; ``index``: collection, file_path and the chunks' columns."""
    current = files.select("collection", F.col("path").alias("file_path")).distinct()
    known = index.select("collection", F.col("file_path").alias("path")).distinct()
    keys = ["collection", "file_path"]
    return files.join(known, ["collection", "path"], "left_anti"), index.join(current, keys, "left_anti"), index.join(current, keys, "left_semi")


def fingerprint(content: Column | str) -> Column:
    """What tells a file's content from another: 64 hexadecimal digits; null contents are empty."""
    content = F.col(content) if isinstance(content, str) else content
    return F.sha2(F.coalesce(content.cast("binary"), F.lit("").cast("binary")), 256)


def sync_content(files: DataFrame, index: DataFrame) -> DataFrame:
    """collection, path, status, chunks: each file of either side, once: ``new``, ``changed``, ``same`` or ``gone``, and how many chunks the index has of it.

    ``files``: collection, path, fingerprint; ``index``: collection, file_path, fingerprint and the chunks' other columns. A file is the same if all of its
    chunks have its fingerprint: one that was half written is changed. Both sides are one union and one aggregate, summed in each task before it is shuffled.
    """
    sides = files.select("collection", "path", F.col("fingerprint").alias("now"), F.lit(None).cast("string").alias("old"), F.lit(0).alias("chunk"))
    sides = sides.unionByName(index.select("collection", F.col("file_path").alias("path"), F.lit(None).cast("string").alias("now"), F.coalesce("fingerprint", F.lit("")).alias("old"), F.lit(1).alias("chunk")))
    rows = sides.groupBy("collection", "path").agg(F.max("now").alias("now"), F.min("old").alias("least"), F.max("old").alias("most"), F.sum("chunk").alias("chunks"))
    same = (F.col("least") == F.col("now")) & (F.col("most") == F.col("now"))
    status = F.when(F.col("now").isNull(), "gone").when(F.col("least").isNull(), "new").when(same, "same").otherwise("changed")
    return rows.select("collection", "path", status.alias("status"), "chunks")


def resync(index: DataFrame, status: DataFrame, chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The index after a sync: chunks of same files stay, those of gone and changed ones go, all of them, however many a changed file has now; ``chunks`` of new and changed files come in.

    Files in ``failed`` (collection, file_path) couldn't be read or embedded: of these nothing comes in, and a changed one keeps what it had, under its old fingerprint. So
    it is still changed, or new, at the next sync. Twice is once.
    """
    keys = ["collection", "file_path"]
    files = status.select("collection", F.col("path").alias("file_path"), "status")
    done = files if failed is None else files.join(failed.select(*keys).distinct(), keys, "left_anti").unionByName(files.join(failed.select(*keys).distinct(), keys, "left_semi").withColumn("status", F.when(F.col("status") == "changed", "same").otherwise("failed")))
    stays = index.join(done.filter("status = 'same'").select(*keys), keys, "left_semi")
    comes = chunks.join(done.filter("status in ('new', 'changed')").select(*keys), keys, "left_semi")
    return stays.select(*index.columns).unionByName(comes.select(*[c for c in index.columns if c in comes.columns]), allowMissingColumns=True)


def observed_chunks(chunks: DataFrame, collections: list[str], name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The chunks, and an observation that counts those of each collection, and the bytes, as they are written: a report costs no second reading.

    ``collections`` are those of the sync's report, at most MOST_COLLECTIONS; others are counted together as ``other``. ``observation.get`` has the counts after the write.
    """
    if len(collections) > MOST_COLLECTIONS:
        raise ValueError("too many collections for one observation")
    seen = Observation(name)
    counts = [F.count_if(F.col("collection") == c).alias(f"chunks of {c}") for c in collections]
    other = F.count_if(~F.coalesce(F.col("collection").isin(*collections), F.lit(False))).alias("other") if collections else F.count("*").alias("other")
    return chunks.observe(seen, F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("document")), F.lit(0)).alias("bytes"), other, *counts), seen


def upsert_collection(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Incoming rows and the existing ones whose key doesn't come in. Twice is once."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def check_vectors(rows: DataFrame, dim: int, vector: str = "dense") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has ``dim`` components, none null; and the others. A null vector is no vector of that size."""
    good = F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def ingest_report(new: DataFrame, chunks: DataFrame, orphans: DataFrame) -> DataFrame:
    """collection, new_files, chunks, orphans: counts of each, 0 where there are none."""
    counted = [(new, "new_files"), (chunks, "chunks"), (orphans, "orphans")]
    rows = None
    for df, name in counted:
        part = df.groupBy("collection").agg(F.count("*").alias("n")).select("collection", *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for _, c in counted])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("collection").agg(*[F.sum(c).alias(c) for _, c in counted])
