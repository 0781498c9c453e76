"""Connected components of a graph of links, by contraction; nothing of it passes through the driver or one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.llm.common import cut


def _order(x: Column | str) -> Column:
    """Nodes by a hash, so that each round at least halves a chain on average, however its ids lie."""
    x = F.col(x) if isinstance(x, str) else x
    return F.struct(F.xxhash64(x, F.lit(17)).alias("h"), x.alias("v"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links lead to. Only nodes with a link have a row.

    In each round a node goes to the first of itself and its neighbours, in the hash's order; links between the
    places reached make the next round's graph, which ends when none is left. A round's minima are summed up in
    each task before they are shuffled, so a node with very many links is no hot spot; the joins split one.
    Loops and repeated links do no harm; an empty table gives an empty table.
    """
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    places = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(_order("b")).alias("o"))
        step = cut(best.select(F.col("a").alias("node"), F.least(F.col("o"), _order("a"))["v"].alias("to")), "steps")
        if places is None:
            places = step.withColumnRenamed("to", "at")
        else:
            moved = step.select(F.col("node").alias("at"), "to")
            places = cut(places.join(moved, "at", "left").select("node", F.coalesce("to", "at").alias("at")), "places")
        moves = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        moved = edges.join(moves, "a").join(moves.select(F.col("a").alias("b"), F.col("a2").alias("b2")), "b")
        edges = cut(moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    if places is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = places.groupBy("at").agg(F.min("node").alias("component"))
    return cut(places.join(smallest, "at").select("node", "component"), "components")
