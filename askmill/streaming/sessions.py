"""Session logs as streams: idle or aged sessions are flushed, and flushed ratings keep the cache up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from askmill.config import CACHED_ANSWER
from askmill.functions.hooks import embed
from askmill.operators import cache as caches
from askmill.streaming import versions

#: How late an entry may come; later ones are dropped.
DELAY = "10 minutes"
#: A message that closes its session at once.
CLEAR = "__clear__"


def sessionize(stream: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """session_id, start, last, entries of each session once it has been idle for ``gap``. Append mode."""
    rows = stream.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("entries"), F.max("ts").alias("last"))
    return rows.select("session_id", F.col("w.start").alias("start"), "last", "entries")


#: What a session's state keeps of a question's newest entry, besides the question.
_ENTRY = ("msg", "answer", "display_docs")
FLUSHED = "session_id string, start timestamp, question_id string, msg string, answer string, display_docs string, rating int"


def _text(x) -> str | None:
    return None if x is None or x != x else str(x)


class _Runs(StatefulProcessor):
    """Runs of entries less than a gap apart (``idle``), or that begin less than a span after the first (``age``), closed by event-time timers.

    The state is keyed: a run's start and end, and of each run and question the newest rated entry. So it grows with the questions, not with the entries,
    and a batch touches only the questions that it has. A clearing message closes what came before it, by the entries' times.
    """

    def __init__(self, gap: int, policy: str):
        self.gap, self.policy = gap, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "start long", "last long")
        self.newest = handle.getMapState("newest", "start long, question string", "ts long, seq long, msg string, answer string, display_docs string, rating int")

    def _due(self, start: int, last: int) -> int:
        """The time, in milliseconds, from which a run is over."""
        return -(-((last if self.policy == "idle" else start) + self.gap) // 1000)

    def _joins(self, run: tuple[int, int], start: int, last: int) -> bool:
        if self.policy == "age":
            return run[0] - self.gap < start < run[0] + self.gap
        return start < run[1] + self.gap and run[0] < last + self.gap

    def _close(self, key: tuple, over: list[tuple[int, int]], until: int | None = None) -> list[tuple]:
        """What these runs have to give, and their end; with ``until``, of each only what is no later."""
        if not over:
            return []
        starts, out, kept = {s for s, _ in over}, [], {}
        for k, e in list(self.newest.iterator()):
            if k[0] in starts and (until is None or e[0] <= until):
                out.append((key[0], pd.Timestamp(k[0], unit="us"), k[1] or None, *e[2:]))
                self.newest.removeKey(tuple(k))
            elif k[0] in starts:
                kept.setdefault(k[0], []).append(e[0])
        for start, last in over:
            if until is None or last <= until:
                self.handle.deleteTimer(self._due(start, last))
                self.runs.removeKey((start,))
            elif start <= until:  # what is later goes on as a run of its own
                self._move((start, last), min(kept.get(start, [last])), last)
        return sorted(out, key=str)

    def _move(self, run: tuple[int, int], start: int, last: int) -> None:
        """A run that begins or ends elsewhere now."""
        self.handle.deleteTimer(self._due(*run))
        if run[0] != start:
            self.runs.removeKey((run[0],))
            for k, e in [(k, e) for k, e in self.newest.iterator() if k[0] == run[0]]:
                self.newest.removeKey(tuple(k))
                self._put(start, k[1], tuple(e))
        self.runs.updateValue((start,), (last,))
        self.handle.registerTimer(self._due(start, last))

    def _put(self, start: int, question: str, entry: tuple) -> None:
        old = self.newest.getValue((start, question)) if self.newest.containsKey((start, question)) else None
        if old is None or (entry[0], -entry[1]) > (old[0], -old[1]):
            self.newest.updateValue((start, question), entry)

    def _add(self, rows: pd.DataFrame) -> None:
        """Entries in order, none of which clears."""
        at = rows["us"].to_numpy()
        cuts = np.flatnonzero(np.diff(at) >= self.gap) + 1 if self.policy == "idle" else np.arange(1, len(at))
        known = [(k[0], v[0]) for k, v in self.runs.iterator()]
        for part in np.split(np.arange(len(at)), cuts):
            start, last = int(at[part[0]]), int(at[part[-1]])
            met = [r for r in known if self._joins(r, start, last)]
            for r in met:
                start, last = min(start, r[0]), max(last, r[1])
            known = [r for r in known if r not in met] + [(start, last)]
            for r in met:
                if r != (start, last):
                    self._move(r, start, last)
            if not met:
                self._move((start, last), start, last)
            rated = rows.iloc[part][rows["rating"].iloc[part].notna().to_numpy()]
            # Rows are in order of time; of one time, the first append counts.
            newest = rated.sort_values(["us", "seq"], ascending=[True, False], kind="stable").groupby("q", sort=False).tail(1)
            for r in newest.itertuples():
                self._put(start, r.q, (int(r.us), int(r.seq), *(_text(getattr(r, c)) for c in _ENTRY), int(r.rating)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        us = every["ts"].astype("datetime64[us]").astype("int64")
        every = every.assign(us=us, q=every["question_id"].fillna("")).sort_values(["us", "seq"], kind="stable")
        clears, out, done = np.flatnonzero((every["msg"] == CLEAR).to_numpy()), [], 0
        for k in [*clears.tolist(), None]:
            if len(every.iloc[done:k]):
                self._add(every.iloc[done:k])
            if k is not None:
                until = int(every["us"].iloc[k])
                out += self._close(key, [(s[0], v[0]) for s, v in list(self.runs.iterator()) if s[0] <= until], until)
                done = k + 1
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        yield self._frame(self._close(key, [(s[0], v[0]) for s, v in list(self.runs.iterator()) if self._due(s[0], v[0]) <= now]))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["session_id", "start", "question_id", *_ENTRY, "rating"])

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Has the session's streams keep their state in the store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _closed_runs(stream: DataFrame, gap: int, policy: str, delay: str) -> DataFrame:
    keyed_state(stream.sparkSession)
    have = [F.col(c).cast("string").alias(c) if c in stream.columns else F.lit(None).cast("string").alias(c) for c in caches.CARRIED]
    rows = stream.filter("session_id is not null and ts is not null").select("session_id", *have, "rating", "ts", "seq").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(_Runs(gap, policy), FLUSHED, "Append", "EventTime")


def _microseconds(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {interval})").alias("n")).first().n


def flush_stream(stream: DataFrame, gap: str, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    """Gives ``sink`` the newest rating of each question of the sessions that a batch closes; their state then goes.

    Every entry keeps its session alive; of the rated ones the newest of each question is the state, whatever a session's length. Entries may come in any
    order within ``delay``: one between two runs makes them one. ``checkpoint`` is a folder that all executors share. A batch may
    come again after a failure, with the same number. Entries without a session or a time belong to none.
    """
    rows = _closed_runs(stream, _microseconds(stream.sparkSession, gap), "idle", delay)
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def timed_sessions(stream: DataFrame, minutes: int, policy: str = "idle", delay: str = DELAY) -> DataFrame:
    """session_id, question_id, msg, answer, display_docs, rating of sessions closed by a timer or by a clearing message.

    ``idle``: the timer starts anew with each entry, rated or not; ``age``: it runs from the first. Only the newest entry of each
    question is kept as state, so a long session's state is bounded by its questions. A clearing message closes what came before it, by the
    entries' times: what is later begins a session of its own, even in one batch, or if the message comes late.
    """
    if policy not in ("idle", "age"):
        raise ValueError(f"no policy {policy!r}")
    return _closed_runs(stream, minutes * 60_000_000, policy, delay).drop("start")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache that ``maintain_cache`` keeps below ``path``: answers with their vectors, to be searched with ``cached_answers`` and served."""
    return versions.read(spark, path, "question_id", CACHED_ANSWER)


def maintain_cache(path: str, checkpoint: str, collection: str = "cache", **hook) -> Callable[[DataFrame, int], None]:
    """A sink for ``flush_stream`` with this checkpoint: each batch appends the answers that it rates or brings, new ones with the vector of their question.

    A repeated batch changes nothing, nor does another stream's batch of the same number. ``hook``: the embedding model, as ``embed`` takes it.
    """

    def sink(latest: DataFrame, number: int) -> None:
        spark = latest.sparkSession
        stream = versions.stream_of(spark, checkpoint)
        rows = caches.changes(read_cache(spark, path), latest)
        fresh = embed(rows.filter("status = 'new'").drop("dense"), "question", "dense", **hook).withColumn("collection", F.lit(collection))
        rows = rows.filter("status = 'updated'").unionByName(fresh)
        versions.append(rows.select([F.col(f.name).cast(f.dataType) for f in CACHED_ANSWER]), path, stream, number)

    return sink


def route_stream(questions: DataFrame, cache: DataFrame | Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "top1") -> StreamingQuery:
    """Routes questions (collection, query_id, qvec) as they come: a batch's top answers need its whole window, so each batch is a job of its own.

    ``cache``: the answers, or what gives them. A function is called for each batch, so that ``living_cache`` serves what streams have put in since.
    """

    def batch(df: DataFrame, number: int) -> None:
        now = cache(df.sparkSession) if callable(cache) else cache
        sink(caches.route(df, caches.cached_answers(df, now, mode)), number)

    return questions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def living_cache(path: str) -> Callable[[SparkSession], DataFrame]:
    """The newest version of the cache below ``path``, whenever it is asked for."""
    return lambda spark: read_cache(spark, path)


def ingest_stream(files: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Chunks new files and appends each batch's chunks to the table below ``path``; ``versions.read`` gives the newest chunk of each id."""

    def batch(df: DataFrame, number: int) -> None:
        versions.append(chunk(df), path, versions.stream_of(df.sparkSession, checkpoint), number)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a stream came too late so far, and were dropped: of the batches whose progress is kept (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
