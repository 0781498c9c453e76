"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.common import WORD, cut, running_total

#: Rounds of the documents that a source can give.
ROUNDS = 3
#: Leading hexadecimal digits of the shuffle's hash that make a bucket of the running totals: 4096 for each source.
DIGITS = 3
#: Ranges of virtual time in which the mix is sorted.
RANGES = 4096


def targets(sizes: DataFrame, source: str = "source", cycle: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """Per source (a row each in ``sizes``: source, source_size): weight, target, finish.

    Weights are 1 to ``cycle`` in the sources' order, repeating, null last. All sources are served at a rate in
    proportion to their weights until one runs out after ``rounds`` rounds; the rest share what it leaves. So a
    source gets weight * V, or all it has, where V (``finish``) is the virtual time at which the budget, the
    sum of all sizes, is used up. The windows order sources: a row for each, no documents.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weighted = sizes.select(source, "source_size", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).alias("weight"))
    full = (F.lit(rounds) * F.col("source_size")).alias("full")
    rows = weighted.withColumn("full", full).withColumn("runs_out", F.col("full") / F.col("weight"))
    by_end = Window.orderBy("runs_out", F.col(source).asc_nulls_last())
    before = by_end.rowsBetween(Window.unboundedPreceding, -1)
    here = by_end.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("spent", F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn("rest_weight", F.sum("weight").over(here)).withColumn("budget", F.sum("source_size").over(whole))
    # What is served by a virtual time is concave in it: each way of saying which sources have run out gives a time
    # that is too early, but the right way; so V is the largest.
    rows = rows.withColumn("v", (F.col("budget") - F.col("spent")) / F.col("rest_weight"))
    rows = rows.withColumn("finish", F.max("v").over(whole))
    return rows.select(source, "source_size", "weight", "finish", F.when(F.col("runs_out") <= F.col("finish"), F.col("full").cast("double")).otherwise(F.col("weight") * F.col("finish")).alias("target"))


def fair_queue(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", rounds: int = ROUNDS, seed: str = "mix") -> DataFrame:
    """Per document: key, source, size, source_size, target, taken, copies, first_finish (the virtual finish of its first copy), weight.

    A source's documents come in the order of a hash of their key, round after round. A copy's virtual finish is
    the source's words up to its middle, divided by the source's weight; the global order by that is the mix (``mix_order`` sorts it). It is
    cut at the virtual time at which the budget is used up, which ``targets`` gives: a
    document is taken once for each copy whose middle comes before. So each source is off its target by
    at most half of one document. Null texts have size 0 and are never taken; documents of one key tie and
    are told apart by their size; a null source is one of its own. An empty table gives an empty table.
    """
    sized = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = cut(sized.withColumn("shuffle", F.md5(F.concat_ws("|", F.lit(seed), F.col("k").cast("string")))), "sizes")
    sources = targets(sized.groupBy("s").agg(F.sum("size").alias("source_size")), "s", rounds=rounds)
    ahead = running_total(sized.withColumn("bucket", F.substring("shuffle", 1, DIGITS)), ["s"], ["shuffle", "k", "size"], "size", "ahead", "bucket")
    sources = sources.withColumnRenamed("s", "s2")
    rows = ahead.join(F.broadcast(sources) if _few(sources) else sources, F.col("s").eqNullSafe(F.col("s2")))
    middle = F.col("ahead") + F.col("size") / 2
    copies = F.when((F.col("size") == 0) | (F.col("source_size") == 0), 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(rounds), F.floor((F.col("target") - middle) / F.col("source_size")) + 1))
    )
    out = rows.withColumn("copies", copies.cast("int"))
    return out.select(
        F.col("k").alias(key), F.col("s").alias(source), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", (middle / F.col("weight")).alias("first_finish"), "weight", "finish", "shuffle"
    )


def mix_order(plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The plan of ``fair_queue`` with a row for each copy that is taken, and one for a document that isn't: copy (from 0), copy_finish, position.

    position is the copy's place in the global order by virtual finish (ties: the shuffle's order, the key, the copy), from 0; null if it isn't taken. The order is a
    range-sort: copies are dealt by ranges of virtual time, of equal widths, as all sources are served evenly over it; each range is sorted on
    its own, and the ranges' counts are summed up before. What lies beyond the virtual time of the budget is cut off.
    """
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), "copies") - 1)))
    rows = rows.withColumn("copy_finish", F.col("first_finish") + F.col("copy") * F.col("source_size") / F.col("weight"))
    place = F.least(F.lit(1.0), F.coalesce(F.col("copy_finish") / F.when(F.col("finish") > 0, F.col("finish")), F.lit(0.0)))
    taken = F.col("copies") > 0
    rows = rows.withColumns({"one": taken.cast("long"), "bucket": F.when(taken, F.floor(place * RANGES)).otherwise(RANGES + 1 + F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(RANGES)))})
    placed = running_total(rows, [], ["copy_finish", "shuffle", key, "copy"], "one", "position", "bucket")
    return placed.withColumn("position", F.when(taken, F.col("position"))).drop("one", "bucket")


def _few(sources: DataFrame, most: int = 20_000) -> bool:
    """Whether there are so few sources that each executor can hold them all (a row of some 60 bytes each)."""
    return sources.limit(most + 1).count() <= most


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated as often as it takes them, with their columns only.

    In its source's order a document is taken as often as the one before it, or once less, and that only once in a source: so a source's last document
    that is taken more often than others tells of each document, where it is read, how often it is taken. No text is shuffled while sources are few enough to send. Rows of one key,
    source and size have one place in the order; where the source's change falls among these, they alone are numbered, so that their copies differ by one at most.
    """
    plan = fair_queue(docs.select(key, source, text), key, source, text, rounds).filter("size > 0")
    place = F.struct("shuffle", F.col(key).alias("k"), "size")
    of = plan.groupBy(F.col(source).alias("__s")).agg(F.max("copies").alias("__most"), F.min("copies").alias("__least"))
    last = plan.join(F.broadcast(of) if _few(of) else of, F.col(source).eqNullSafe(F.col("__s"))).filter(F.col("copies") == F.col("__most"))
    last = last.groupBy("__s", "__most", "__least").agg(F.max(place).alias("__last"))
    # How many rows have that place, and how often all of these are taken.
    few = _few(last)
    named = last.withColumnRenamed("__s", "__s2")
    ties = plan.join(F.broadcast(named) if few else named, F.col(source).eqNullSafe(F.col("__s2")) & (place == F.col("__last"))).groupBy("__s2").agg(F.count("*").alias("__rows"), F.sum("copies").alias("__copies"))
    cuts = cut(last.join(ties, F.col("__s").eqNullSafe(F.col("__s2"))).drop("__s2"), "cuts")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    shuffled = F.md5(F.concat_ws("|", F.lit("mix"), F.col(key).cast("string")))
    here = F.struct(shuffled.alias("shuffle"), F.col(key).alias("k"), size.alias("size"))
    rows = docs.withColumn("__here", here).filter("__here.size > 0").join(F.broadcast(cuts) if few else cuts, F.col(source).eqNullSafe(F.col("__s")))
    whole = (F.col("__here") != F.col("__last")) | (F.col("__copies") == F.col("__rows") * F.col("__most"))
    sure = rows.filter(whole).withColumn("__n", F.when(F.col("__here") <= F.col("__last"), F.col("__most")).otherwise(F.col("__least")))
    tied = rows.filter(~whole).withColumn("__nth", F.row_number().over(Window.partitionBy("__s").orderBy(F.xxhash64(text))))
    tied = tied.withColumn("__n", F.floor(F.col("__copies") / F.col("__rows")) + F.when(F.col("__nth") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)).drop("__nth")
    taken = sure.withColumn("__n", F.col("__n").cast("long")).unionByName(tied.withColumn("__n", F.col("__n").cast("long"))).filter("__n > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)
