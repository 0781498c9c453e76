"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is named, local mode gets a temporary one for the session; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="askmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """The name of a folder in the shared one that no other job has."""
    return f"{shared_dir(spark)}/askmill-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "step", codec: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again, so that later jobs and lost executors don't repeat what came before."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of what is read, for each core, up to which rows may be dealt anew.
SPREAD = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows, dealt evenly over twice the cores: a file of one row group is one task otherwise, however many cores there are. A large one is split well as it is read, and stays so."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return df.repartition(2 * cores) if size <= SPREAD * cores else df
