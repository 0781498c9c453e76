"""Queries against a corpus in blocks: a pair of blocks is one matrix of scores, of which only each query's best leave."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.sources.shared import cut

#: Bytes of query blocks that each executor may be sent.
MOST_SENT = 64 << 20
#: Bytes of query blocks that meet one part of the corpus, where they are too many to send.
PART = 512 << 20
HITS = "query_id string, id string, score double"
#: A row of a batch: column -> its value. A kernel takes a query block's and a corpus block's.
Row = Callable[[str], pa.Scalar]
Kernel = Callable[[Row, Row], Iterator[pa.RecordBatch]]


def bytes_of(df: DataFrame) -> int:
    """The bytes of all columns of ``df``: of strings, binaries and arrays of strings what they hold, of any other value eight."""

    def one(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        if kind in ("string", "binary"):
            return F.octet_length(c)
        if kind == "array<string>":
            return F.octet_length(F.array_join(c, "")) + 8 * F.size(c)
        return F.lit(8)

    total = functools.reduce(lambda a, b: a + b, [F.coalesce(one(c), F.lit(0)).cast("long") for c in df.columns])
    return df.agg(F.sum(total)).first()[0] or 0


def searched(queries: DataFrame, corpus: DataFrame, by: list[str], kernel: Kernel, ids: str = "c_ids") -> DataFrame:
    """query_id, id, score: what ``kernel`` yields of each query block with each corpus block of equal ``by``. ``ids``: the corpus block's ids.

    Query blocks go to each executor once if their bytes, all columns counted, are few; then only corpus blocks flow, and nothing of the
    corpus is shuffled. Else the corpus is dealt over parts, and the query blocks are repeated for each: so a collection is as many tasks as
    it has parts, and no task holds more than some query blocks at a time.
    """
    queries = cut(queries, "queries")
    total = bytes_of(queries)
    if total <= MOST_SENT:
        sink = pa.BufferOutputStream()
        table = queries.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        sent = queries.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of: dict[tuple, list[Row]] = {}
            for batch in pa.ipc.open_stream(sent.value):
                for r, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True)):
                    of.setdefault(key, []).append(lambda c, batch=batch, r=r: batch.column(c)[r])
            for batch in batches:
                for r, key in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True)):
                    for query in of.get(key, []):
                        yield from kernel(query, lambda c, batch=batch, r=r: batch.column(c)[r])

        return corpus.mapInArrow(run, HITS)
    parts = max(2 * corpus.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PART))
    dealt = corpus.withColumn("__part", F.pmod(F.xxhash64(F.get(ids, F.lit(0))), F.lit(parts)).cast("int"))
    repeated = queries.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = lambda c, r=r: batch.column(c)[r]  # noqa: B023, E731  used before the next batch
                yield from kernel(row, row)

    return dealt.join(repeated.hint("shuffle_hash"), [*by, "__part"]).drop("__part").mapInArrow(both, HITS)


def best(scores: np.ndarray, query_ids: list[str], ids: list[str], k: int, others: bool) -> Iterator[pa.RecordBatch]:
    """The hits of a matrix (queries, chunks): of each query the k best finite scores, and all that tie with the k-th as ranks round them, so that the order of blocks doesn't matter."""
    place, names = {x: n for n, x in enumerate(ids)}, np.array(ids, object)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, query in enumerate(query_ids):
        s = scores[n]
        if others and query in place:
            s[place[query]] = -np.inf
        rounded = np.round(s, 9)
        least = np.partition(rounded, -min(k, len(s)))[-min(k, len(s))]
        at = np.flatnonzero((rounded >= least) & np.isfinite(s))
        rows.append((np.full(len(at), query, object), names[at], s[at]))
    if rows:
        a, b, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], names=["query_id", "id", "score"])
