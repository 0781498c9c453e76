"""A keyed table that streams keep up: each micro-batch appends only the rows that it changes; readers take the newest row of each key.

A batch's rows are a folder ``delta-<number>-<stream>-<batch>``. The stream is known by its checkpoint, so a batch that comes again after a
failure is told from the same batch number of another stream, and is not put in twice. ``compact`` writes the newest rows as a folder ``base-<number>``;
what lies before the base then isn't read any more. Nothing that may be read is overwritten.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"(base|delta)-(\d+)(?:-(\w+)-(\d+))?$")


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[tuple[int, str, str | None, int | None, str]]:
    """number, kind, stream, batch, name of the complete folders below ``path``, in order."""
    hadoop, root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = [(m, s.getPath()) for s in fs.listStatus(root) if (m := _NAME.match(s.getPath().getName()))]
    done = [(int(m[2]), m[1], m[3], int(m[4]) if m[4] else None, p.getName()) for m, p in found if fs.exists(hadoop.Path(p, "_SUCCESS"))]
    return sorted(done, key=lambda x: x[:2])


def stream_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the query of this checkpoint: the same after each restart from it."""
    text = spark.read.text(f"{checkpoint}/metadata").first().value
    return re.sub(r"\W", "", re.search(r'"id"\s*:\s*"([^"]+)"', text)[1])


def append(rows: DataFrame, path: str, stream: str, batch: int) -> None:
    """Puts a batch's rows in, if they aren't there yet."""
    done = folders(rows.sparkSession, path)
    if not any(x[2:4] == (stream, batch) for x in done):
        number = done[-1][0] + 1 if done else 0
        rows.write.mode("overwrite").parquet(f"{path}/delta-{number}-{stream}-{batch}")


def _current(done: list) -> list:
    last = max((k for k, x in enumerate(done) if x[1] == "base"), default=0)
    return done[last:]


def read(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The newest row of each key."""
    current = _current(folders(spark, path))
    if not current:
        return spark.createDataFrame([], schema)
    # Two streams that append at once take one number: then the stream's name decides, the same way for all readers.
    name = r"/(?:base|delta)-(\d+)(?:-(\w+)-(\d+))?/[^/]*$"
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), name, k)
    number = F.struct(part(1).cast("int").alias("n"), part(2).alias("stream"), F.coalesce(part(3).try_cast("int"), F.lit(0)).alias("batch"))
    rows = spark.read.schema(schema).parquet(*[f"{path}/{x[4]}" for x in current])
    if len(current) == 1:
        return rows
    return rows.select(F.col(key).alias("__key"), F.struct(*schema.names).alias("row"), number.alias("n")).groupBy("__key").agg(F.max_by("row", "n").alias("row")).select("row.*")


def compact(spark: SparkSession, path: str, key: str, schema: T.StructType) -> None:
    """Writes the newest rows as the new base, and removes what lies before the base that it follows. To be called between batches, by one job."""
    done = folders(spark, path)
    current = _current(done)
    if len(current) < 2:
        return
    read(spark, path, key, schema).write.mode("overwrite").parquet(f"{path}/base-{done[-1][0] + 1}")
    hadoop, _, fs = _fs(spark, path)
    # Readers may still be at the base that was the newest so far, and at what follows it. A removed delta's stream is past its batch.
    for x in done[: len(done) - len(current)]:
        fs.delete(hadoop.Path(f"{path}/{x[4]}"), True)
