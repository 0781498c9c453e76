"""Exact dense retrieval in blocks, and late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.operators.blocks import Row, best, searched
from askmill.operators.lexical import top_k

#: Vectors of a block of the corpus, and of a block of queries.
BLOCK, QUERIES = 4096, 256


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """collection, d and, in a row for up to ``size`` vectors: their ids and the unit vectors as doubles. Null vectors and those with a null, NaN or infinite component go; a zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            collections, d = batch.column("collection").to_pylist(), np.asarray(batch.column("d"))
            kinds: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(collections, d.tolist(), strict=True)):
                kinds.setdefault(key, []).append(k)
            for (collection, n), of in kinds.items():
                for k in range(0, len(of), size):
                    at = pa.array(of[k : k + size])
                    x = np.asarray(batch.column("vec").take(at).flatten(), np.float64).reshape(len(at), n)
                    most = np.abs(x).max(1, keepdims=True)  # keeps squares of very large or small components finite
                    x = x / np.where(most > 0, most, 1)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x = x / np.where(norm > 0, norm, 1)
                    yield pa.RecordBatch.from_arrays([pa.array([collection], pa.string()), pa.array([n], pa.int32()), pa.array([batch.column("id").take(at).to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())], names=["collection", "d", f"{name}_ids", f"{name}_vecs"])

    rows = rows.filter("vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.select("collection", "id", "vec", F.size("vec").alias("d")).mapInArrow(run, f"collection string, d int, {name}_ids array<string>, {name}_vecs binary")


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, others: bool = False) -> DataFrame:
    """query_id, id, score, rank: the chunks of the query's collection with the largest cosine.

    ``queries``: collection, query_id, qvec; ``corpus``: collection, id, dense. Both are packed in blocks, so a
    pair of blocks is one matrix product and the join moves blocks, not vectors; from each pair only the best k of a query
    leave. ``others``: a chunk doesn't match the query of its own id.
    """
    q = _blocks(queries.select("collection", F.col("query_id").cast("string").alias("id"), F.col("qvec").alias("vec")), QUERIES, "q")
    c = _blocks(corpus.select("collection", F.col("id").cast("string").alias("id"), F.col("dense").alias("vec")), BLOCK, "c")

    def kernel(query: Row, chunk: Row) -> Iterator[pa.RecordBatch]:
        d = chunk("d").as_py()
        qs, cs = (np.frombuffer(x.as_buffer()).reshape(-1, d) for x in (query("q_vecs"), chunk("c_vecs")))
        yield from best(np.round(qs @ cs.T, 12), query("q_ids").as_py(), chunk("c_ids").as_py(), k, others)

    return top_k(searched(q, c, ["collection", "d"], kernel), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def maxsim(pairs: DataFrame, query: str = "qlate", late: str = "late", out: str = "score") -> DataFrame:
    """query_id, id and, for each vector of the query, its best cosine over the chunk's vectors, summed. Both sides hold unit vectors; a chunk without vectors, or a query, goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                n = np.diff(np.asarray(column.offsets))
                inner = column.flatten()
                sides.append((np.asarray(inner.flatten(), np.float64), np.diff(np.asarray(inner.offsets)), n))
            # Rows of equal shapes are one product.
            (qx, qd, qn), (cx, cd, cn) = sides
            width = [np.maximum.reduceat(d, np.cumsum(n) - n) if len(n) else n for _, d, n in sides]
            score = np.empty(len(qn))
            for q, c, d in sorted(set(zip(qn.tolist(), cn.tolist(), width[0].tolist(), strict=True))):
                at = np.flatnonzero((qn == q) & (cn == c) & (width[0] == d))
                x, y = (v[(s[at][:, None] + np.arange(m * d))].reshape(len(at), m, d) for v, s, m in ((qx, _starts(qd, qn), q), (cx, _starts(cd, cn), c)))
                score[at] = np.einsum("nqd,ncd->nqc", x, y).max(2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "id", out])

    rows = pairs.filter(f"size({query}) > 0 and size({late}) > 0")
    same = F.forall(F.concat(query, late), lambda v: F.size(v) == F.size(F.col(late)[0]))
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return rows.filter(same).select("query_id", "id", query, late).mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, {out} double")


def _starts(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each row's components start, if row k has n[k] vectors of these sizes."""
    ends = np.cumsum(sizes)
    return np.r_[0, ends][np.cumsum(n) - n]
