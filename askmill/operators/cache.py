"""The cache of rated answers: look-up, routing, flushing of sessions and upkeep of ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.config import SESSION_ENTRY, SearchConfig
from askmill.functions.text import clean_answer
from askmill.operators.dense import dense_topk


def cached_answers(queries: DataFrame, cache: DataFrame, mode: str = "top1", cfg: SearchConfig = SearchConfig(), others: bool = False) -> DataFrame:
    """query_id, question_id, score, rating: at most one cached answer for each query.

    ``top1``: the nearest, if it is near enough, whatever its rating. ``first_rated``: the nearest, if near enough and rated
    above 3. ``best_rated``: of the near ones among the first few, the best rated above 3; the nearest of equals.
    """
    if mode not in ("top1", "first_rated", "best_rated"):
        raise ValueError(f"no mode {mode!r}")
    corpus = cache.select("collection", F.col("question_id").cast("string").alias("id"), "dense")
    hits = dense_topk(queries, corpus, cfg.cache_probe, others).filter(F.round("score", 9) >= cfg.cache_threshold)
    rated = hits.join(cache.select(F.col("question_id").cast("string").alias("id"), "rating"), "id")
    order = [F.col("rank")] if mode != "best_rated" else [F.col("rating").desc(), F.col("rank")]
    if mode == "best_rated":
        rated = rated.filter(F.col("rating") > cfg.least_rating)
    best = rated.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter("n = 1")
    if mode == "first_rated":
        best = best.filter(F.col("rating") > cfg.least_rating)
    return best.select("query_id", F.col("id").alias("question_id"), "score", "rating")


def route(queries: DataFrame, cached: DataFrame) -> DataFrame:
    """query_id, route, question_id: ``cache`` where an answer was found, ``search`` elsewhere."""
    rows = queries.select(F.col("query_id").cast("string").alias("query_id")).join(cached.select("query_id", "question_id"), "query_id", "left")
    return rows.select("query_id", F.when(F.col("question_id").isNull(), "search").otherwise("cache").alias("route"), "question_id")


#: What an entry carries into the cache.
CARRIED = ("question_id", "msg", "answer", "display_docs")


def _newest(entries: DataFrame, more: tuple[str, ...] = ("ts",)) -> Column:
    """The newest entry with what it carries and its truncated rating; the earlier append wins ties."""
    have = [F.col(c) if c in entries.columns else F.lit(None).cast("string").alias(c) for c in CARRIED]
    return F.max_by(F.struct(*have, F.col("rating").cast("int").alias("rating"), *more), F.struct("ts", -F.col("seq")))


def latest_ratings(entries: DataFrame, null_key: str = "collapse") -> tuple[DataFrame, DataFrame]:
    """The newest entry of each session and question, and the entries without a rating, which are rejected.

    The earlier append wins ties. Fresh questions have no id: they are one key (``collapse``) or one for each
    message (``per_question``). Ratings are truncated. Answers and documents to show stay with their entry.
    """
    if null_key not in ("collapse", "per_question"):
        raise ValueError(f"no null_key {null_key!r}")
    key = F.col("question_id") if null_key == "collapse" else F.coalesce("question_id", "msg")
    rated = entries.filter("rating is not null").withColumn("__key", key)
    latest = rated.groupBy("session_id", "__key").agg(_newest(entries).alias("e")).select("session_id", "e.*")
    return latest, entries.filter("rating is null")


def apply_ratings(cache: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cached answers that were rated, all columns kept, with their new rating and rating_count; and the ratings of unknown ones.

    Sums and counts of a question's ratings are made in each task first; the running average over all of them is
    what applying one after the other gives.
    """
    known = latest.filter("question_id is not null")
    sums = known.groupBy("question_id").agg(F.sum("rating").alias("added"), F.count("*").alias("m"))
    joined = cache.join(sums, "question_id")
    new = {"rating": (F.col("rating") * F.col("rating_count") + F.col("added")) / (F.col("rating_count") + F.col("m")), "rating_count": F.col("rating_count") + F.col("m")}
    return joined.withColumns(new).select(*cache.columns), known.join(cache.select("question_id"), "question_id", "left_anti")


def new_answers(latest: DataFrame) -> DataFrame:
    """question_id, question, answer, display_docs, rating, rating_count of answers to fresh questions. Ids come from session and message, so reruns agree."""
    fresh = latest.filter("question_id is null")
    of = lambda c: F.col(c) if c in latest.columns else F.lit(None).cast("string")
    return fresh.select(
        F.md5(F.concat_ws("|", "session_id", "msg")).alias("question_id"), F.col("msg").alias("question"), of("answer").alias("answer"), of("display_docs").alias("display_docs"),
        F.col("rating").cast("double").alias("rating"), F.lit(1).cast("long").alias("rating_count"),
    )


def changes(cache: DataFrame, latest: DataFrame) -> DataFrame:
    """The rows of the cache that a flush changes or adds, with the cache's columns and status (updated, new). New rows have what a flush knows: no vector yet."""
    updated, _ = apply_ratings(cache, latest)
    fresh = new_answers(latest)
    # The same fresh question of a session in two flushes is one row, which the later flush replaces.
    fresh = fresh.groupBy("question_id").agg(F.max(F.struct(*[c for c in fresh.columns if c != "question_id"])).alias("e")).select("question_id", "e.*")
    kinds = {f.name: f.dataType for f in cache.schema}
    added = [(F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in cache.columns]
    return updated.withColumn("status", F.lit("updated")).unionByName(fresh.select(*added, F.lit("new").alias("status")))


def upsert(cache: DataFrame, latest: DataFrame) -> DataFrame:
    """The whole cache after a flush, with its columns and status: updated, new and untouched rows, one for each key."""
    changed = changes(cache, latest)
    rest = cache.join(changed.select("question_id"), "question_id", "left_anti")
    return changed.unionByName(rest.withColumn("status", F.lit("untouched")))


def answered(routes: DataFrame, cache: DataFrame, generated: DataFrame) -> DataFrame:
    """query_id, route, answer, display_docs, error: the cached answer where a query is routed to one, else the one that was generated for it, without its thoughts.

    ``routes`` as ``route`` gives them; ``generated``: query_id, answer, error, and display_docs if there are any.
    """
    known = cache.select("question_id", "answer", "display_docs")
    cached = routes.filter("route = 'cache'").join(known, "question_id").select("query_id", "route", "answer", "display_docs", F.lit(None).cast("string").alias("error"))
    shown = F.col("display_docs") if "display_docs" in generated.columns else F.lit(None).cast("string")
    made = generated.select(F.col("query_id").cast("string").alias("query_id"), clean_answer("answer").alias("answer"), shown.alias("display_docs"), "error")
    rest = routes.filter("route = 'search'").select("query_id", "route").join(made, "query_id")
    return cached.unionByName(rest)


def sessions(entries: DataFrame, gap: str) -> DataFrame:
    """session_id, start, end, entries: runs of entries, each less than ``gap`` after the one before: at the gap itself a session is over."""
    rows = entries.groupBy("session_id", F.session_window("ts", f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("entries"), F.max("ts").alias("last"))
    return rows.select("session_id", F.col("w.start").alias("start"), F.col("last").alias("last"), "entries")


def flush(entries: DataFrame, gap: str, now: str | None = None, immediate: bool = False) -> DataFrame:
    """session_id, start, question_id, msg, answer, display_docs, rating: the newest rating of each question in each session that has been idle for ``gap``.

    Every entry keeps its session alive, rated or not; only rated ones leave it. Entries of one span of ``gap`` from the epoch are less than
    ``gap`` apart, so they are of one session: sessions are runs of such spans' first and last entries, and the newest ratings are
    chosen in the spans first. No session's entries are gathered, however many it has. ``immediate`` closes every session.
    """
    span = F.floor(F.unix_micros("ts") / F.expr(f"unix_micros(timestamp_micros(0) + interval {gap})"))
    timed = entries.filter("ts is not null").withColumn("span", span)
    found = timed.filter("rating is not null").groupBy("session_id", "span", F.col("question_id").alias("q")).agg(_newest(entries, ("ts", "seq")).alias("e"))
    w = Window.partitionBy("s").orderBy("p")
    spans = timed.groupBy(F.col("session_id").alias("s"), F.col("span").alias("p")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    fresh = F.coalesce(F.col("first") >= F.lag("last").over(w) + F.expr(f"interval {gap}"), F.lit(True))
    spans = spans.withColumn("n", F.when(fresh, F.col("first"))).withColumn("start", F.last("n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not immediate:
        idle = spans.groupBy(F.col("s").alias("s2"), F.col("start").alias("start2")).agg(F.max("last").alias("end")).filter(F.col("end") + F.expr(f"interval {gap}") <= F.lit(now).cast("timestamp"))
        spans = spans.join(idle, F.col("s").eqNullSafe(F.col("s2")) & (F.col("start") == F.col("start2")), "left_semi")
    rows = found.join(spans.select("s", "p", "start"), F.col("session_id").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p")))
    best = F.max_by("e", F.struct(F.col("e.ts"), -F.col("e.seq")))
    return rows.groupBy("session_id", "start", "q").agg(best.alias("e")).select("session_id", "start", *[f"e.{c}" for c in CARRIED], "e.rating")


def read_sessions(log: DataFrame, entry: str = "entry") -> DataFrame:
    """The entries of a session log, decoded from their JSON; a table or a stream. Text that is no JSON object gives nulls."""
    return log.select(F.from_json(entry, SESSION_ENTRY).alias("e")).select("e.*")
