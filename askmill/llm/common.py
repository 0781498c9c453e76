"""What the operators share: reading tables, cutting lineage, running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.sources.shared import cut, shared_dir  # noqa: F401  for the operators

#: A word: any run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, out: str, bucket: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``by`` that come before this one in ``order``.

    ``bucket`` is a column that rises with ``order``, with any number of rows to a bucket. Sums of the buckets
    are made first; a window then orders only the buckets of a key and another only the rows of a bucket, so that
    a hot key is spread over as many tasks as it has buckets.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__{c}") for c in [*by, bucket]], F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, bucket]]
    own = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(base, same).withColumn(out, F.col("__base") + F.col("__own")).drop("__own", "__base", *[f"__{c}" for c in [*by, bucket]])


def dealt(df: DataFrame, *by: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal ``by`` side by side in one partition, in ``order``, for ``groups`` to take them up."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.repartition(n, *by).sortWithinPartitions(*by, *order)


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``by``, each as a table. One run at a time is held, however many there are."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
        at = 0
        for k in range(len(keys)):
            if keys[k] != (keys[k - 1] if k else last):
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at = [], k
        held.append(batch.slice(at))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)
