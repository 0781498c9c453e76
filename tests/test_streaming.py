from datetime import datetime, timedelta

from pyspark.sql import functions as F

from askmill.config import CACHED_ANSWER, SESSION_ENTRY
from askmill.functions.hooks import query_embed
from askmill.operators import cache
from askmill.streaming import sessions, versions

T0 = datetime(2024, 1, 1)


def log(spark):
    rows = []
    for k in range(60):
        rows.append((f"s{k % 5}", f"q{k % 4}" if k % 3 else None, f"m{k}", float(k % 6), T0 + timedelta(minutes=7 * k), k))
    rows.append(("end", "q", "m", 1.0, T0 + timedelta(days=9), 99))
    return spark.createDataFrame(rows, "session_id string, question_id string, msg string, rating double, ts timestamp, seq long")


def stream(spark, path):
    return spark.readStream.schema(log(spark).schema).option("maxFilesPerTrigger", 1).parquet(path)


def written(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = log(spark)
    for k in range(3):
        rows.filter(F.floor(F.col("seq") / 20) == k if k < 2 else F.col("seq") >= 40).coalesce(1).write.mode("append").parquet(path)
    return path


def test_streamed_flush_equals_batch_flush(spark, tmp_path):
    path, found = written(spark, tmp_path), []
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        sessions.flush_stream(stream(spark, path), "30 minutes", lambda df, n: found.extend((r.session_id, r.start, r.question_id, r.msg, r.rating) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    want = cache.flush(log(spark), "30 minutes", now="2024-01-09 00:00:00").collect()
    assert sorted(map(str, found)) == sorted(str((r.session_id, r.start, r.question_id, r.msg, r.rating)) for r in want) and found


def test_unrated_entries_keep_a_session(spark, tmp_path):
    rows = [("s", "q", "m0", 2.0, 0), ("s", "q", "m1", None, 20), ("s", "q", "m2", 4.0, 40), ("s", "r", "m3", 5.0, 90), ("end", "q", "m", 1.0, 9000)]
    df = spark.createDataFrame([(s, q, m, r, T0 + timedelta(minutes=t), k) for k, (s, q, m, r, t) in enumerate(rows)], log(spark).schema)
    want = [("s", T0, "q", "m2", 4), ("s", T0 + timedelta(minutes=90), "r", "m3", 5)]
    of = lambda r: (r.session_id, r.start, r.question_id, r.msg, r.rating)
    assert sorted(map(of, cache.flush(df, "30 minutes", now="2024-01-02 00:00:00").collect())) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    sessions.flush_stream(stream(spark, str(tmp_path / "in")), "30 minutes", lambda df, n: found.extend(map(of, df.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(found) == want


def test_cache_is_kept_up_and_answers(spark, tmp_path):
    path, out = written(spark, tmp_path), str(tmp_path / "cache")

    def run(checkpoint):
        sessions.flush_stream(stream(spark, path), "30 minutes", sessions.maintain_cache(out, checkpoint), checkpoint).awaitTermination()
        return {r.question_id: r for r in sessions.read_cache(spark, out).collect()}

    first = run(str(tmp_path / "cp"))
    flushed = cache.flush(log(spark), "30 minutes", now="2024-01-09 00:00:00").collect()
    assert {r.question for r in first.values()} == {r.msg for r in flushed if r.question_id is None} and len(first) > 0
    assert all(len(r.dense) == 64 and r.rating_count == 1 and r.collection == "cache" for r in first.values())
    # A repeated batch changes nothing; a stream with a new checkpoint starts at batch 0 again, and is put on top.
    assert run(str(tmp_path / "cp")) == first and run(str(tmp_path / "other")) == first
    rated = spark.createDataFrame([("t", k, "again", 5, None, None) for k in list(first)[:1]], "session_id string, question_id string, msg string, rating int, answer string, display_docs string")
    sessions.maintain_cache(out, str(tmp_path / "cp"))(rated, 77)
    sessions.maintain_cache(out, str(tmp_path / "cp"))(rated, 77)
    now = {r.question_id: r for r in sessions.read_cache(spark, out).collect()}
    (changed,) = [i for i in now if now[i] != first[i]]
    assert now[changed].rating_count == 2 and now[changed].question == first[changed].question
    for _ in range(2):
        versions.compact(spark, out, "question_id", CACHED_ANSWER)
        assert {r.question_id: r for r in sessions.read_cache(spark, out).collect()} == now
    # What the stream has written is searched and served.
    some = list(now.values())[0]
    asked = query_embed(spark.createDataFrame([("cache", "known", some.question), ("cache", "new", "nothing like it")], "collection string, query_id string, text string"))
    table = sessions.read_cache(spark, out)
    routes = cache.route(asked, cache.cached_answers(asked, table))
    made = spark.createDataFrame([("new", "<think>x</think> said", None)], "query_id string, answer string, error string")
    got = {r.query_id: (r.route, r.answer) for r in cache.answered(routes, table, made).collect()}
    assert got == {"known": ("cache", some.answer), "new": ("search", "said")}


def timed(spark, tmp_path, batches, policy="idle", minutes=30):
    path = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(s, q, m, r, T0 + timedelta(minutes=t), 100 * k + n) for n, (s, q, m, r, t) in enumerate(rows)], log(spark).schema)
        df.coalesce(1).write.mode("append").parquet(path)
    name = f"timed_{tmp_path.name}".replace("-", "_")
    sessions.timed_sessions(stream(spark, path), minutes, policy).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.session_id, r.question_id, r.msg, r.rating) for r in spark.table(name).collect())


def test_timed_sessions_by_age(spark, tmp_path):
    rows = [("a", "q", "m0", 1.0, 0), ("a", "q", "m1", 2.0, 20), ("b", "q", "m2", 3.0, 0)]
    got = timed(spark, tmp_path, [rows, [("end", "q", "m", 1.0, 35)], [("end", "q", "m", 1.0, 46)], [("end", "q", "m", 1.0, 60)]], "age")
    assert got == [("a", "q", "m1", 2), ("b", "q", "m2", 3)]


def test_timed_sessions_are_renewed(spark, tmp_path):
    rows = [("a", "q", "m0", 1.0, 0), ("a", None, "m1", None, 25), ("b", "q", "m2", 3.0, 0)]
    got = timed(spark, tmp_path, [rows, [("end", "q", "m", 1.0, 45)], [("end", "q", "m", 1.0, 46)], [("end", "q", "m", 1.0, 47)]])
    assert got == [("b", "q", "m2", 3)]  # a's unrated entry at 25 minutes keeps it beyond 35


def test_clearing_closes_what_came_before(spark, tmp_path):
    clear = ("a", None, sessions.CLEAR, None, 5)
    got = timed(spark, tmp_path, [[("a", "q", "m0", 1.0, 0), clear, ("a", "q", "m1", 2.0, 6), ("b", "r", "m2", 3.0, 6)]])
    assert got == [("a", "q", "m0", 1)]


def test_a_late_clearing_keeps_newer_entries(spark, tmp_path):
    got = timed(spark, tmp_path, [[("a", "q", "m0", 1.0, 0), ("a", "r", "m1", 2.0, 6)], [("a", None, sessions.CLEAR, None, 3)]])
    assert got == [("a", "q", "m0", 1)]


def test_sessionize(spark, tmp_path):
    path = written(spark, tmp_path)
    q = sessions.sessionize(stream(spark, path), "30 minutes").writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = cache.sessions(log(spark).filter("session_id <> 'end'"), "30 minutes").count()
    assert spark.table("made").count() == want


def test_entries_have_a_schema():
    assert "question_id" in SESSION_ENTRY.names


def test_files_are_ingested_once(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("files", "index", "cp"))
    chunk = lambda df: df.select("id", F.upper("document").alias("document"))
    for rows in ([("a", "x"), ("b", "y")], [("b", "z")], []):
        if rows:
            spark.createDataFrame(rows, "id string, document string").coalesce(1).write.mode("append").parquet(source)
        sessions.ingest_stream(spark.readStream.schema("id string, document string").parquet(source), chunk, out, cp).awaitTermination()
    schema = spark.createDataFrame([], "id string, document string").schema
    assert {r.id: r.document for r in versions.read(spark, out, "id", schema).collect()} == {"a": "X", "b": "Z"}


def test_questions_are_routed(spark, tmp_path):
    schema, found = "collection string, query_id string, qvec array<double>", []
    spark.createDataFrame([("c", "near", [1.0, 0.0]), ("c", "far", [0.0, 1.0])], schema).coalesce(1).write.parquet(str(tmp_path / "q"))
    table = spark.createDataFrame([("c", "c1", [0.9, 0.1], 4.0)], "collection string, question_id string, dense array<double>, rating double")
    sessions.route_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "q")), table, lambda df, n: found.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(found) == [("far", "search", None), ("near", "cache", "c1")]


def read_state(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def test_entries_out_of_order_make_the_same_sessions(spark, tmp_path):
    """Entries come up to 8 minutes late, so runs that seemed apart are one."""
    import random

    rng = random.Random(2)
    rows = [(f"s{rng.randint(0, 2)}", rng.choice(["q", "r", None]), f"m{k}", rng.choice([None, 1.0, 4.0]), T0 + timedelta(seconds=rng.randint(60, 400) * k // 4), k) for k in range(200)]
    df = spark.createDataFrame(rows + [("end", "q", "m", 1.0, T0 + timedelta(days=9), 999)], log(spark).schema)
    order = sorted(rows, key=lambda r: r[4] + timedelta(seconds=rng.randint(0, 480)))
    for k in range(0, len(order), 25):
        spark.createDataFrame(order[k : k + 25], log(spark).schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.filter("session_id = 'end'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found, of = [], lambda r: str((r.session_id, r.start, r.question_id, r.msg, r.rating))
    sessions.flush_stream(stream(spark, str(tmp_path / "in")), "5 minutes", lambda b, n: found.extend(map(of, b.collect())), str(tmp_path / "cp")).awaitTermination()
    want = cache.flush(df, "5 minutes", now="2024-01-09 00:00:00").collect()
    assert sorted(found) == sorted(map(of, want)) and len({r.start for r in want}) > 5


def test_state_grows_with_questions_not_with_entries(spark, tmp_path):
    rows = spark.range(100_000).select(F.lit("s").alias("session_id"), F.concat(F.lit("q"), F.col("id") % 10).alias("question_id"), F.concat(F.lit("m"), "id").alias("msg"), (F.col("id") % 5).cast("double").alias("rating"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("seq"))
    rows.filter("id < 60000").drop("id").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("id >= 60000").drop("id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cp, found = str(tmp_path / "cp"), []
    sessions.flush_stream(stream(spark, str(tmp_path / "in")), "30 minutes", lambda df, n: found.extend(df.collect()), cp).awaitTermination()
    assert read_state(spark, cp, "newest").count() == 10 and read_state(spark, cp, "runs").count() == 1 and not found
    spark.createDataFrame([("end", "q", "m", 1.0, datetime(2024, 1, 1), 1)], log(spark).schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sessions.flush_stream(stream(spark, str(tmp_path / "in")), "30 minutes", lambda df, n: found.extend(df.collect()), cp).awaitTermination()
    assert sorted((r.question_id, r.msg) for r in found) == [(f"q{k}", f"m{99_990 + k}") for k in range(10)]
    assert {r.user_map_key.start for r in read_state(spark, cp, "newest").collect()} == {int(datetime(2024, 1, 1).timestamp() * 1e6)}


def test_a_routed_stream_serves_what_came_since(spark, tmp_path):
    """Between two batches of questions the cache gets an answer: the second batch is served it."""
    out, questions, found = str(tmp_path / "cache"), str(tmp_path / "q"), []
    asked = query_embed(spark.createDataFrame([("cache", "a", "what is it"), ("cache", "b", "what is it")], "collection string, query_id string, text string"))
    flushes = sessions.flush_stream(stream(spark, written(spark, tmp_path)), "30 minutes", lambda df, n: df.collect(), str(tmp_path / "cp"))
    flushes.awaitTermination()
    put = sessions.maintain_cache(out, str(tmp_path / "cp"))
    fresh = spark.createDataFrame([("s", None, "what is it", "that", None, 5)], "session_id string, question_id string, msg string, answer string, display_docs string, rating int")

    def sink(df, number):
        found.extend((r.query_id, r.route) for r in df.collect())
        if number == 0:
            put(fresh, 0)

    for k in "ab":
        asked.filter(F.col("query_id") == k).coalesce(1).write.mode("append").parquet(questions)
    rows = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(questions)
    sessions.route_stream(rows, sessions.living_cache(out), sink, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r for _, r in found) == ["cache", "search"] and [r for _, r in found][0] == "search"


def test_appends_of_one_number_are_read_alike(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, v int").schema
    for stream_name, v in (("aa", 1), ("zz", 2)):
        spark.createDataFrame([("k", v)], schema).coalesce(1).write.parquet(str(tmp_path / f"delta-3-{stream_name}-7"))
    spark.createDataFrame([("k", 0)], schema).coalesce(1).write.parquet(str(tmp_path / "base-2"))
    assert [r.v for r in versions.read(spark, str(tmp_path), "id", schema).collect()] == [2]


def test_late_rows_are_counted(spark, tmp_path):
    for k, minute in enumerate((0, 600, 601, 1)):
        spark.createDataFrame([("s", "q", "m", 1.0, T0 + timedelta(minutes=minute), k)], log(spark).schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = sessions.sessionize(stream(spark, str(tmp_path / "in")), "30 minutes").writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sessions.late_rows(q) == 1
