"""Tables of results that are kept between runs: what a model gave for a text isn't asked of it again.

A run's results are files in a folder of its own. Each task's files are put in place as the task ends, so that they stay if the run dies. A result is known
by a checksum of what was asked; if two runs gave one at the same time, readers take one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that a result is known by.
ASKED = "asked"


def checksum(text: Column | str) -> Column:
    """32 bytes; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def read(spark: SparkSession, path: str, schema: T.StructType, order: Column | None = None) -> DataFrame:
    """asked and the results below ``path``, one for each text, the least by ``order`` of several; none if there is no such folder yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    # Files that a task hasn't finished lie in folders whose names begin with an underscore, which readers pass over.
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    values = [f.name for f in schema if f.name != ASKED]
    return rows.groupBy(ASKED).agg(F.min_by(F.struct(*values), F.lit(0) if order is None else order.cast("int")).alias("row")).select(ASKED, "row.*")


def append(rows: DataFrame, path: str) -> None:
    """Puts results in, task by task."""
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path}/run-{uuid.uuid4().hex}")


def missing(asked: DataFrame, kept: DataFrame) -> DataFrame:
    """The distinct rows of ``asked`` that have no result yet: asked and the text of each."""
    return asked.groupBy(ASKED).agg(F.first("text").alias("text")).join(kept.select(ASKED), ASKED, "left_anti")
