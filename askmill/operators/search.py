"""Weighted hybrid search, prefetch with late rerank, and what follows a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.config import SEARCH_REPLY, SearchConfig
from askmill.operators.dense import dense_topk, maxsim
from askmill.operators.lexical import sparse_topk, top_k

HIT = "query_id string, id string, score double, rank int"
#: How far equal scores may be apart, as they were summed in another order.
ALIKE = 1e-11


def minmax_scores(hits: DataFrame, by: tuple[str, ...] = ("query_id", "side")) -> DataFrame:
    """Adds scaled: scores of each query and side from 0 to 1; where all are equal, 1.

    Sums of the same numbers in another order differ in their last bits, so all are equal if no more than ALIKE (of the larger one, where that is above 1) lies between
    them: else those bits would be spread over 0 to 1.
    """
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    alike = high - low <= ALIKE * F.greatest(F.lit(1.0), F.abs(high), F.abs(low))
    return hits.withColumn("scaled", F.when(alike, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(dense: DataFrame | None, sparse: DataFrame | None, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, id, score, source, dense_score, sparse_score, rank from the limited hits of both sides.

    Thresholds (at least) come after the limits, scaling after the thresholds. A side that is None, or has no hits, adds none;
    both None is an error. Ties keep dense hits in their order, then the others in theirs.
    """
    if dense is None and sparse is None:
        raise ValueError("dense or sparse hits are needed")
    empty = (dense if dense is not None else sparse).limit(0)
    sides = []
    for name, hits, least in (("dense", dense, cfg.dense_threshold), ("sparse", sparse, cfg.sparse_threshold)):
        rows = (empty if hits is None else hits).filter(F.col("score") >= least)
        sides.append(rows.select("query_id", "id", "score", F.col("rank"), F.lit(name).alias("side")))
    scaled = minmax_scores(sides[0].unionByName(sides[1]))
    # One group per query and id holds both sides: the union and its aggregate are the full outer join, on one partitioning.
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = scaled.groupBy("query_id", "id").agg(
        F.coalesce(of("dense", "scaled"), F.lit(0.0)).alias("d"), F.coalesce(of("sparse", "scaled"), F.lit(0.0)).alias("s"),
        F.coalesce(of("dense", "score"), F.lit(0.0)).alias("dense_score"), F.coalesce(of("sparse", "score"), F.lit(0.0)).alias("sparse_score"),
        of("dense", "rank").alias("dense_rank"), of("sparse", "rank").alias("sparse_rank"),
    )
    scored = both.withColumn("score", cfg.alpha * F.col("d") + (1 - cfg.alpha) * F.col("s")).filter(F.round("score", 9) >= cfg.threshold)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top_k)
    return ranked.select("query_id", "id", "score", F.when(F.col("d") >= F.col("s"), "dense").otherwise("sparse").alias("source"), "dense_score", "sparse_score", "rank")


def hybrid_search(queries: DataFrame, terms: DataFrame, corpus: DataFrame, index: DataFrame, cfg: SearchConfig = SearchConfig(), others: bool = False) -> DataFrame:
    """Weighted search over both sides' best chunks. ``queries`` has vectors, ``terms`` the queries' words, ``index`` the chunks' words."""
    return fuse(dense_topk(queries, corpus, cfg.dense_limit, others), sparse_topk(terms, index, cfg.sparse_limit, others=others), cfg)


def candidate_union(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, id: each id that either side has found, once."""
    return dense.select("query_id", "id").unionByName(sparse.select("query_id", "id")).distinct()


def late_rerank(candidates: DataFrame, query_late: DataFrame, late: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, id, score, rank: the candidates with the largest MaxSim. ``query_late``: query_id, qlate; ``late``: id, late (unit vectors).

    Late vectors are wide, so they are joined only to the candidates.
    """
    return top_k(maxsim(candidates.join(late, "id").join(query_late, "query_id")), cfg.late_limit)


def search(method: str, **parts) -> DataFrame:
    """``hybrid`` or ``dense`` with the parts that each takes; ``top_k`` overrides the configuration's."""
    cfg, k = parts.pop("cfg", SearchConfig()), parts.pop("top_k", None)
    if method == "dense":
        return dense_topk(parts["queries"], parts["corpus"], k or cfg.top_k)
    if method == "hybrid":
        from dataclasses import replace

        return hybrid_search(cfg=replace(cfg, top_k=k) if k else cfg, **parts)
    raise ValueError(f"no method {method!r}")


#: What a payload's known keys are if it lacks them.
DEFAULTS = {"document": "", "file_path": "—", "display_docs": "", "rating": 0.0, "rating_count": 0}


def with_defaults(rows: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """The known keys with their defaults where they are null, ``but`` these, which stay null; a key without a column gets one."""
    return rows.withColumns({c: F.coalesce(c, F.lit(x)) if c in rows.columns else F.lit(x) for c, x in DEFAULTS.items() if c not in but or c not in rows.columns})


def attach_payload(hits: DataFrame, collection: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """The hits with what the collection knows of their chunk, looked up after the top k; absent keys get their defaults, ``but`` these stay null.

    Both sides' hits are chunks of one collection, so a hit found by both has one payload. Where the hits have both sides' raw
    scores, the payload map gets them too, 0 for a side that has not found the chunk.
    """
    known = [c for c in (*DEFAULTS, "payload") if c in collection.columns]
    rows = with_defaults(hits.join(collection.select("id", *known), "id", "left"), but)
    scores = [c for c in ("dense_score", "sparse_score") if c in hits.columns]
    added = [x for c in scores for x in (F.lit(f"_{c}"), F.col(c).cast("string"))]
    payload = F.coalesce("payload", F.expr("cast(map() as map<string, string>)")) if "payload" in known else F.expr("cast(map() as map<string, string>)")
    return rows.withColumn("payload", F.map_concat(F.map_filter(payload, lambda k, _: ~k.isin(*[f"_{c}" for c in scores])), F.create_map(*added)) if added else payload)


def explode_hits(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """query_id, id, score, source: a row for each document of a JSON reply; none for a reply without documents."""
    rows = replies.select("query_id", F.explode(F.from_json(reply, SEARCH_REPLY)["documents"]).alias("d"))
    return rows.select("query_id", F.col("d.id").cast("string").alias("id"), F.col("d.score").alias("score"), F.col("d.source").alias("source"))


def search_report(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, dense_hits, sparse_hits."""
    rows = dense.select("query_id", F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(sparse.select("query_id", F.lit(0).alias("d"), F.lit(1).alias("s")))
    return rows.groupBy("query_id").agg(F.sum("d").alias("dense_hits"), F.sum("s").alias("sparse_hits"))


def hit_counts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """collection, method, hits: how many hits each method has in each collection. ``hits``: query_id, method; ``queries``: query_id, collection. Counted by query first, so that a collection with most of the hits is no hot spot."""
    per = hits.groupBy("query_id", "method").agg(F.count("*").alias("n"))
    rows = per.join(queries.select(F.col("query_id").cast("string").alias("query_id"), "collection").distinct(), "query_id")
    return rows.groupBy("collection", "method").agg(F.sum("n").alias("hits"))
