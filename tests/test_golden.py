"""Small tables whose rows follow from the rules."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askmill.config import SearchConfig
from askmill.functions.hooks import embed, generate, query_embed
from askmill.functions.text import clean_answer, chunks, normalize_queries, runs, sentences
from askmill.operators import blocks, cache, chat, dense, ingest, lexical, search, snapshots
from askmill.sources import shared, tables
from askmill.sources.collections import create_collection, ingest_texts

HITS = "query_id string, id string, score double, rank int"


def hits(spark, found):
    return spark.createDataFrame([("q", i, float(s), n + 1) for n, (i, s) in enumerate(found)], HITS)


def test_minmax(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "x", 0.7), ("a", "x", 0.5), ("b", "x", 0.4), ("b", "x", 0.4), ("c", "x", 2.3)], "query_id string, side string, score double")
    got = sorted((r.query_id, round(r.scaled, 6)) for r in search.minmax_scores(df).collect())
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 1.0)]


def test_last_bits_of_equal_scores_are_not_scaled(spark):
    parts = [0.1 * n + 400 for n in range(9)]
    sums = [sum(parts), sum(parts[::-1]), sum(parts) * (1 + 2**-50)]
    assert len(set(sums)) > 1
    df = spark.createDataFrame([("copies", "x", s) for s in sums] + [("close", "x", s) for s in (4.0, 4.0 + 1e-8)], "query_id string, side string, score double")
    assert sorted((r.query_id, r.scaled) for r in search.minmax_scores(df).collect()) == [("close", 0.0), ("close", 1.0)] + [("copies", 1.0)] * 3
    ranked = search.fuse(None, spark.createDataFrame([("q", f"c{n}", s, n + 1) for n, s in enumerate(sums)], HITS))
    assert [(r.id, r.score) for r in ranked.orderBy("rank").collect()] == [("c0", 0.5), ("c1", 0.5), ("c2", 0.5)]


DENSE, SPARSE = [("a", 0.9), ("b", 0.7), ("c", 0.5), ("d", 0.4)], [("b", 6), ("e", 4), ("a", 2), ("f", 1.5)]


@pytest.mark.parametrize(("threshold", "k", "want"), [(0.3, 10, ["b", "a"]), (0.25, 10, ["b", "a", "e"]), (0.3, 1, ["b"])])
def test_hybrid(spark, threshold, k, want):
    got = search.fuse(hits(spark, DENSE), hits(spark, SPARSE), SearchConfig(threshold=threshold, top_k=k)).orderBy("rank").collect()
    assert [r.id for r in got] == want
    assert got[0].source == "sparse"


def test_hybrid_sides(spark):
    one = search.fuse(None, hits(spark, [("x", 5), ("y", 3)])).collect()
    assert [(r.id, r.score, r.source) for r in one] == [("x", 0.5, "sparse")]
    tie = search.fuse(hits(spark, [("a", 0.8)]), hits(spark, [("e", 3.0)])).orderBy("rank").collect()
    assert [(r.id, r.source) for r in tie] == [("a", "dense"), ("e", "sparse")]
    assert search.fuse(hits(spark, []), hits(spark, [])).count() == 0
    with pytest.raises(ValueError):
        search.fuse(None, None)
    with pytest.raises(ValueError):
        SearchConfig(alpha=1.5)


def test_maxsim(spark):
    rows = spark.createDataFrame([("x", [[1.0, 0.0]]), ("y", [[0.6, 0.8], [0.8, 0.6]]), ("z", [[0.0, 1.0], [1.0, 0.0]])], "id string, late array<array<double>>")
    q = spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 1.0]])], "query_id string, qlate array<array<double>>")
    got = search.late_rerank(rows.select(F.lit("q").alias("query_id"), "id"), q, rows).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("z", 2.0), ("y", 1.6), ("x", 1.0)]


def test_maxsim_of_any_shape(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        d = int(rng.integers(1, 5))
        rows.append((f"q{k}", f"c{k}", *(rng.normal(size=(int(rng.integers(1, 6)), d)).tolist() for _ in range(2))))
    odd = [("q90", "c90", None, [[1.0]]), ("q91", "c91", [[1.0]], None), ("q92", "c92", [], [[1.0]]), ("q93", "c93", [[1.0]], [[1.0, 2.0]])]
    df = spark.createDataFrame(rows + odd, "query_id string, id string, qlate array<array<double>>, late array<array<double>>")
    got = {r.query_id: r.score for r in dense.maxsim(df).collect()}
    assert got == pytest.approx({q: sum(max(float(np.dot(a, b)) for b in c) for a in v) for q, _, v, c in rows})


def test_late_parts(spark):
    rows = [("a", [float(k + 1) for k in range(128)]), ("b", [1.0] * 65), ("c", None), ("d", []), ("e", [3.0] * 64)]
    got = {r.id: r.l for r in tables.late(spark.createDataFrame(rows, "id string, v array<float>"), "v", "l").collect()}
    assert [len(x) for x in got["a"]] == [16] * 8 and got["a"][1][0] / got["a"][1][1] == pytest.approx(17 / 18)
    assert got["b"] is got["c"] is got["d"] is None and [len(x) for x in got["e"]] == [8] * 8


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_tokenised_once(spark):
    corpus = spark.createDataFrame([("1", "a", "red apple red"), ("2", "b", "sky"), ("1", "c", None)], "collection string, id string, text string")
    index = lexical.build_index(corpus)
    assert sorted((r.collection, r.id, r.dl, r.terms, r.tfs) for r in index.collect()) == [("1", "a", 3, ["apple", "red"], [1, 2]), ("1", "c", 0, [], []), ("2", "b", 1, ["sky"], [1])]
    for df in (index, lexical.build_postings(index), lexical.document_frequencies(index), lexical.pack_index(index), lexical.pack_index(index).filter("n > 1")):
        assert plan_of(df).count("regexp_extract_all") == 1


def test_index_is_kept(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "a", "red apple red"), ("2", "b", "sky"), ("1", "c", None), (None, "d", "apple")], "collection string, id string, text string")
    kept = lexical.read_index(spark, lexical.write_index(corpus, str(tmp_path / "index")))
    assert sorted((r.collection or "", r.n, r.total) for r in kept.groupBy("collection").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()) == [("", 1, 1), ("1", 2, 3), ("2", 1, 1)]
    terms = lexical.query_terms(spark.createDataFrame([("1", "q", "apple"), ("2", "p", "apple")], "collection string, query_id string, text string"))
    found = lexical.sparse_topk(terms, kept)
    assert [(r.query_id, r.id) for r in found.collect()] == [("q", "a")]
    # Of 32 buckets, the search reads the one of its term; the index isn't shuffled.
    plan = plan_of(found)
    assert sum(f"b{k:02d}:struct" in plan for k in range(lexical.BUCKETS)) == 1
    search = plan[plan.rindex("MapInArrow") :]
    assert "Exchange" not in search and "Scan parquet" in search
    assert lexical.sparse_topk(terms.filter("false"), kept).count() == 0
    longer = [r.score for r in lexical.sparse_topk(terms, kept, avgdl=100.0).collect()]
    assert longer[0] > found.collect()[0].score  # the chunk is short beside that mean


def test_search_by_method(spark):
    corpus = spark.createDataFrame([("c", f"d{k}", t, [float(k % 3 == n) for n in range(3)]) for k, t in enumerate(["red apple", "green apple", "blue sky", "", None])], "collection string, id string, text string, dense array<double>")
    queries = spark.createDataFrame([("c", "q", "apple sky", [1.0, 0.0, 0.0]), ("c", "void", "", None)], "collection string, query_id string, text string, qvec array<double>")
    parts = {"queries": queries, "corpus": corpus, "terms": lexical.query_terms(queries), "index": lexical.build_index(corpus)}
    assert {r.id for r in search.search("dense", queries=queries, corpus=corpus, top_k=2).collect()} == {"d0", "d3"}
    found = search.search("hybrid", cfg=SearchConfig(sparse_threshold=0.0, dense_threshold=0.0, threshold=0.0), **parts).collect()
    assert {r.query_id for r in found} == {"q"} and {r.id for r in found} == {"d0", "d1", "d2", "d3", "d4"}
    with pytest.raises(ValueError):
        search.search("none")


def test_bm25_against_brute_force(spark, monkeypatch):
    import math

    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "QUERIES", 3)
    rng = random.Random(4)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]
    texts = [" ".join(rng.choices(words, weights=range(1, 9), k=rng.randint(0, 12))) for _ in range(40)] + [None, "", "x-y 12"]
    rows = [(("c", "d")[k % 2], f"i{k}", t) for k, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "collection string, id string, text string").repartition(3)
    queries = corpus.select("collection", F.col("id").alias("query_id"), "text")
    got = {(r.query_id, r.id): r.score for r in lexical.sparse_topk(lexical.query_terms(queries), lexical.build_index(corpus), 100, others=True).collect()}
    want = {}
    for c in "cd":
        own = [(i, (t or "").split() if "-" not in (t or "") else []) for x, i, t in rows if x == c]
        mean = sum(len(t) for _, t in own) / len(own)
        for q, asked in own:
            for i, t in own:
                if q != i and set(asked) & set(t):
                    df = {w: sum(w in x for _, x in own) for w in set(asked)}
                    want[q, i] = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(asked) & set(t))
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("share", "room"), [(0.0, 1 << 27), (0.3, 1 << 27), (2.0, 1 << 27), (0.3, 2000)])
def test_best_chunks_however_terms_are_scored(spark, monkeypatch, share, room):
    for name, value in (("BLOCK", 16), ("QUERIES", 8), ("SHARE", share or 1e-9), ("PASS", room), ("PAIRS", 50)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(8)
    words = [a + b for a in "abcdefgh" for b in "xyz"]
    rows = [("c", f"i{k:03d}", " ".join(rng.choices(words, weights=range(1, 25), k=rng.randint(1, 30)))) for k in range(150)]
    corpus = spark.createDataFrame(rows, "collection string, id string, text string").repartition(3)
    queries = lexical.query_terms(corpus.select("collection", F.col("id").alias("query_id"), "text").filter("id < 'i040'"))
    index = shared.cut(lexical.pack_index(lexical.build_index(corpus)))
    every = lexical.sparse_topk(queries, index, 1000, others=True).collect()
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in lexical.sparse_topk(queries, index, 5, others=True).collect()}
    assert len(got) == 200 and {k: i for k, (i, _) in got.items()} == {(r.query_id, r["rank"]): r.id for r in every if r["rank"] <= 5}
    assert [s for _, (_, s) in sorted(got.items())] == pytest.approx([r.score for r in sorted(every, key=lambda r: (r.query_id, r["rank"])) if r["rank"] <= 5], rel=1e-12)


def test_a_task_gives_a_query_its_best_alone(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 10)
    copies = spark.createDataFrame([("c", f"i{k:03d}", "red apple") for k in range(200)], "collection string, id string, text string").coalesce(1)
    index = shared.cut(lexical.pack_index(lexical.build_index(copies)).coalesce(1))
    queries = lexical.query_terms(spark.createDataFrame([("c", "p", "apple"), ("c", "i003", "red apple")], "collection string, query_id string, text string"))
    monkeypatch.setattr(lexical, "top_k", lambda hits, k: hits)
    left = lexical.sparse_topk(queries, index, 4, others=True).collect()  # 20 blocks of copies; before, all copies left, as they tie
    assert sorted((r.query_id, r.id) for r in left) == [("i003", f"i{k:03d}") for k in (0, 1, 2, 4)] + [("p", f"i{k:03d}") for k in range(4)]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_query_blocks_sent_or_dealt(spark, monkeypatch, sent):
    monkeypatch.setattr(blocks, "MOST_SENT", sent)
    monkeypatch.setattr(dense, "QUERIES", 2)
    monkeypatch.setattr(dense, "BLOCK", 10)
    rng = random.Random(6)
    rows = [("c", str(k), [rng.gauss(0, 1) for _ in range(4)]) for k in range(90)]
    df = spark.createDataFrame(rows, "collection string, id string, dense array<double>").repartition(5)
    q = df.filter("int(id) < 9").select("collection", F.col("id").alias("query_id"), F.col("dense").alias("qvec"))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(a[1], n + 1): b[1] for a in rows[:9] for n, b in enumerate(sorted(rows, key=lambda b: -cosine(a[2], b[2]))[:3])}
    assert {(r.query_id, r.rank): r.id for r in dense.dense_topk(q, df, 3).collect()} == want


def test_payload(spark):
    found = spark.createDataFrame([("q", "a", 0.5, 0.0), ("q", "gone", 0.0, 3.0)], "query_id string, id string, dense_score double, sparse_score double")
    table = spark.createDataFrame([("a", "text", None, {"k": "v", "_dense_score": "9"})], "id string, document string, rating double, payload map<string,string>")
    got = {r.id: r for r in search.attach_payload(found, table).collect()}
    assert got["a"].payload == {"k": "v", "_dense_score": "0.5", "_sparse_score": "0.0"} and got["gone"].payload == {"_dense_score": "0.0", "_sparse_score": "3.0"}
    assert [tuple(got[i][c] for c in search.DEFAULTS) for i in ("a", "gone")] == [("text", "—", "", 0.0, 0), ("", "—", "", 0.0, 0)]


def test_null_texts_are_no_context(spark):
    found = spark.createDataFrame([("1", "a"), ("1", "none"), ("2", "none"), ("3", "empty")], "query_id string, id string")
    table = spark.createDataFrame([("a", "text", "/a"), ("none", None, None), ("empty", "", "/e")], "id string, document string, file_path string")
    queries = spark.createDataFrame([(k,) for k in range(1, 5)], "query_id int")
    got = {r.query_id: tuple(r)[1:] for r in chat.context_per_query(search.attach_payload(found, table, ("document",)), queries).collect()}
    no = ("—", None, "no_documents")
    assert got == {"1": ("text", f"{chat.DOCUMENTS}/a\n\n—", "ok"), "2": no, "3": ("", f"{chat.DOCUMENTS}/e", "ok"), "4": no}


def test_system_prompts(spark):
    rows = spark.createDataFrame([("chat_1",), ("code_2",), ("odd",)], "session_id string")
    got = {r.session_id: r.system for r in chat.system_prompts(rows, spark.createDataFrame([("chat", "A"), ("code", "B")], "prefix string, system string")).collect()}
    assert got == {"chat_1": "A", "code_2": "B", "odd": None}
    asked = spark.createDataFrame([("1", None, None, None, None)], "query_id string, system string, context string, history string, query string")
    assert chat.build_prompts(asked).first().prompt.count("—") == 3


def test_files_are_listed_and_read(spark, tmp_path):
    (tmp_path / "docs" / "hr").mkdir(parents=True)
    (tmp_path / "docs" / "hr" / "a.txt").write_text("one\ntwo")
    (tmp_path / "docs" / "b.txt").write_text("x")
    (tmp_path / "docs" / "empty.txt").write_text("")
    listed = tables.list_files(spark, str(tmp_path / "docs")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in listed) == [("a.txt", 7), ("b.txt", 1)]
    read = {r.path.rsplit("/", 1)[1]: r.text for r in tables.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert read["a.txt"] == "one\ntwo"


@pytest.mark.parametrize(("c1", "mode", "want"), [(3.0, "top1", "c1"), (3.0, "first_rated", None), (3.0, "best_rated", "c2"), (3.5, "first_rated", "c1"), (3.5, "best_rated", "c2")])
def test_cached(spark, c1, mode, want):
    table = [("c", f"c{n}", [s, (1 - s * s) ** 0.5], r) for n, (s, r) in enumerate([(0.95, c1), (0.90, 4.5), (0.85, 4.5), (0.79, 5.0)], 1)]
    df = spark.createDataFrame(table, "collection string, question_id string, dense array<double>, rating double")
    q = spark.createDataFrame([("c", "q", [1.0, 0.0])], "collection string, query_id string, qvec array<double>")
    assert [r.question_id for r in cache.cached_answers(q, df, mode).collect()] == ([want] if want else [])


ENTRIES = "session_id string, question_id string, msg string, rating double, ts timestamp, seq long"


def test_flush_keys(spark):
    from datetime import datetime

    t = [datetime(2024, 1, 1, 10, k) for k in range(4)]
    log = [("s1", None, "m1", 2.0, t[1], 1), ("s1", None, "m2", 4.9, t[2], 2), ("s1", "q7", "m3", 5.0, t[3], 3), ("s1", "q7", "m4", 1.0, t[3], 4), ("s1", "q8", "m5", None, t[3], 5)]
    df = spark.createDataFrame(log, ENTRIES)
    one, rejected = cache.latest_ratings(df)
    assert sorted((r.question_id or "", r.msg, r.rating) for r in one.collect()) == [("", "m2", 4), ("q7", "m3", 5)]
    assert rejected.count() == 1
    each, _ = cache.latest_ratings(df, "per_question")
    assert sorted((r.msg, r.rating) for r in each.collect()) == [("m1", 2), ("m2", 4), ("m3", 5)]


def test_average(spark):
    table = spark.createDataFrame([("q7", 4.0, 3)], "question_id string, rating double, rating_count long")
    df = lambda *r: spark.createDataFrame([("s", q, "m", x) for q, x in r], "session_id string, question_id string, msg string, rating int")
    assert [tuple(r) for r in cache.apply_ratings(table, df(("q7", 5)))[0].collect()] == [("q7", 4.25, 4)]
    got, rejected = cache.apply_ratings(table, df(("q7", 5), ("q7", 2), ("q99", 1)))
    assert [(r.question_id, round(r.rating, 6), r.rating_count) for r in got.collect()] == [("q7", 3.8, 5)]
    assert [r.question_id for r in rejected.collect()] == ["q99"]
    new = [r for r in cache.upsert(table, df((None, 4))).collect() if r.status == "new"]
    assert [(r.rating, r.rating_count) for r in new] == [(4.0, 1)]
    full = spark.createDataFrame([("q7", "asked", "said", "see", 4.0, 3, [1.0]), ("q8", "a", "b", None, 1.0, 1, None)], "question_id string, question string, answer string, display_docs string, rating double, rating_count long, dense array<float>")
    log = spark.createDataFrame([("s", "q7", "m", "x", "y", 5), ("s", None, "how", "so", "there", 4)], "session_id string, question_id string, msg string, answer string, display_docs string, rating int")
    got = {r.status: r for r in cache.upsert(full, log).collect()}
    assert tuple(got["updated"])[:6] == ("q7", "asked", "said", "see", 4.25, 4) and tuple(got["untouched"])[:6] == ("q8", "a", "b", None, 1.0, 1)
    assert tuple(got["new"])[1:7] == ("how", "so", "there", 4.0, 1, None)


def test_average_is_sequential(spark):
    random.seed(3)
    given = [random.randint(0, 5) for _ in range(20)]
    avg, n = 4.0, 3
    for x in given:
        avg, n = (avg * n + x) / (n + 1), n + 1
    table = spark.createDataFrame([("q", 4.0, 3)], "question_id string, rating double, rating_count long")
    got = cache.apply_ratings(table, spark.createDataFrame([("s", "q", "m", x) for x in given], "session_id string, question_id string, msg string, rating int"))[0].first()
    assert got.rating == pytest.approx(avg) and got.rating_count == n


def test_sync(spark):
    files = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "c"), ("e", "d")], "collection string, path string")
    index = spark.createDataFrame([("c", "b", 0), ("c", "c", 0), ("c", "d", 0), ("c", "d", 1)], "collection string, file_path string, chunk_index int")
    new, orphans, kept = ingest.sync(files, index)
    assert sorted(r.path for r in new.collect()) == ["a", "d"]
    assert [r.file_path for r in orphans.collect()] == ["d", "d"]
    assert sorted(r.file_path for r in kept.collect()) == ["b", "c"]
    assert ingest.upsert_collection(index, index, ("file_path", "chunk_index")).count() == 4


def test_files(spark):
    df = spark.createDataFrame([(p,) for p in ("/docs/hr/a.pdf", "/docs/hr/x/b.PDF", "/docs/law/c.docx", "/docs/d.pdf", "/docs/hr/e.txt")], "path string")
    got = ingest.with_collection(ingest.filter_formats(df), "/docs").collect()
    assert sorted((r.collection, r.path.rsplit("/", 1)[1]) for r in got) == [("hr", "a.pdf"), ("hr", "b.PDF"), ("law", "c.docx")]
    strict = ingest.with_collection(ingest.filter_formats(df, (".pdf", "doc", "docx"), strict_suffix=True), "/docs")
    assert {r.collection for r in strict.collect()} == {"hr"}
    assert ingest.filter_formats(df, ()).count() == 5


def test_answers(spark):
    df = spark.createDataFrame([("<think>a\nb</think>  \n hi <think>x</think>",), (" <think>a</think>b",), ("plain",)], "t string")
    assert [r.x for r in df.select(clean_answer("t").alias("x")).collect()] == ["hi <think>x</think>", " <think>a</think>b", "plain"]


def test_history(spark):
    found = [("c", n, r, t) for n, (r, t) in enumerate([("user", "u1"), ("assistant", "b1"), ("user", "u2"), ("assistant", "b2"), ("user", "x"), ("user", "u3")])]
    df = spark.createDataFrame(found, "conv_id string, turn long, role string, text string")
    got = {r.turn: r.history for r in chat.prompt_history(df).collect()}
    assert got[0] == "—" and got[5] == "Юзер: u1 | Бот: b1\nЮзер: u2 | Бот: b2"


def test_snapshots(spark):
    found = [("docs", "s1", "2024-03-01T12:00:00"), ("docs", "s2", "2024-03-01T11:59:59"), ("docs", "s3", "bad"), ("docs", "s4", "2024-03-31T00:00:01Z"), ("cache", "s5", "2024-03-30T23:59:59")]
    df = spark.createDataFrame(found, "collection string, name string, creation_time string")
    now = "2024-03-31T12:00:00"
    assert [r.name for r in snapshots.old_snapshots(df, now).collect()] == ["s2"]
    assert [r.collection for r in snapshots.due_collections(df, df, now).collect()] == ["cache"]
    assert {tuple(r) for r in snapshots.latest_snapshots(df).collect()} == {("docs", "s4"), ("cache", "s5")}
    wanted = spark.createDataFrame([("docs", None), ("docs", "s1"), ("docs", "zz"), ("nope", "s1")], "collection string, name string")
    assert {tuple(r) for r in snapshots.select_snapshots(wanted, df).collect()} == {("docs", "s4", "ok"), ("docs", "s1", "ok"), ("docs", "zz", "missing")}


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("docs", "a"), ("cache", "b")], "collection string, id string")
    snapshots.write_snapshot(df, str(tmp_path), "s1")
    chosen = spark.createDataFrame([("docs", "s1", "ok"), ("cache", "zz", "missing")], "collection string, name string, status string")
    assert [(r.collection, r.id) for r in snapshots.recover(spark, chosen, str(tmp_path)).collect()] == [("docs", "a")]


def test_restore_over_a_collection(spark, tmp_path):
    at, folder = str(tmp_path / "table"), str(tmp_path / "snaps")
    rows = lambda *x: spark.createDataFrame(list(x), "collection string, id string")
    snapshots.write_snapshot(rows(("docs", "old"), ("cache", "b c")), folder, "s1")
    snapshots.write_snapshot(rows(("a b", "x")), folder, "s2")
    rows(("docs", "new"), ("other", "z")).write.partitionBy("collection").parquet(at)
    found = snapshots.snapshots_below(spark, folder)
    assert {(r.collection, r.name) for r in found.collect()} == {("docs", "s1"), ("cache", "s1"), ("a b", "s2")}
    every = found.select("collection", "name", F.lit("ok").alias("status"))
    assert {(r.collection, r.id) for r in snapshots.restore(spark, every, folder, at).collect()} == {("docs", "old"), ("cache", "b c"), ("a b", "x"), ("other", "z")}
    with pytest.raises(ValueError):
        snapshots.recover(spark, every.limit(0), folder)


@pytest.mark.parametrize("most", [1, 1000])
def test_normalise_by_join_too(spark, monkeypatch, most):
    from askmill.functions import text

    monkeypatch.setattr(text, "MOST_WORDS", most)
    q = spark.createDataFrame([("a", "the cats ran The end"), ("b", None), ("c", "x-ray")], "query_id string, text string")
    stop, lemmas = spark.createDataFrame([("the",), ("ran",)], "word string"), spark.createDataFrame([("cats", "cat"), ("cats", "dog"), ("ran", "run"), ("end", None)], "word string, lemma string")
    assert {r.query_id: r.normalized for r in normalize_queries(q, stop, lemmas).collect()} == {"a": "cat end", "b": "", "c": ""}
    assert {r.normalized for r in normalize_queries(q).collect()} == {"the cats ran the end", ""}


@pytest.mark.parametrize("most", [1, 3, 1 << 18])
def test_batches_are_taken_in_small_parts(spark, monkeypatch, most):
    from askmill.functions import text

    monkeypatch.setattr(text, "AT_ONCE", most)
    texts = ["one two. three. four", None, "", "five", "The one the one. two"]
    rows = spark.createDataFrame([("c", f"q{k}", t) for k, t in enumerate(texts)], "collection string, id string, text string").coalesce(1)
    lists = pa.array([t.split() if t else [] for t in texts]).slice(1)
    parts = list(text.few_at_once(lists))
    assert [x for a, b in parts for x in range(a, b)] == [0, 1, 2, 3] and all(b - a == 1 or sum(map(len, lists.to_pylist()[a:b])) <= most for a, b in parts)
    index = {r.id: dict(zip(r.terms, r.tfs, strict=True)) for r in lexical.build_index(rows).collect()}
    assert index == {"q0": {"one": 1, "two": 1, "three": 1, "four": 1}, "q1": {}, "q2": {}, "q3": {"five": 1}, "q4": {"the": 2, "one": 2, "two": 1}}
    # The function itself is asked: a worker has its own AT_ONCE.
    run = chunks(2, 0).func
    cut = list(run(iter([pa.array([["one two.", "three.", "four"], None, [], ["five"]], pa.list_(pa.string()))])))
    assert [x.to_pylist() for x in cut] == [[["one two.", "three. four"], [], [], ["five"]]]


def test_tokens(spark):
    from askmill.functions.text import tokens

    text = "It's re-do of co-op, a--bc de-- --fg x_y 12ab ÉTÉ İx q1-ww ok-_ end."
    assert spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("x")).first().x == ["it", "of", "bc", "de", "fg", "été", "i̇x", "end"]


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_normalise(spark):
    q = spark.createDataFrame([("q", "Как  настроить кое-что в VPN2 сервере?"), ("s", "Как в")], "query_id string, text string")
    stop = spark.createDataFrame([("как",), ("в",)], "word string")
    lemmas = spark.createDataFrame([("сервере", "сервер")], "word string, lemma string")
    assert {r.query_id: r.normalized for r in normalize_queries(q, stop, lemmas).collect()} == {"q": "настроить сервер", "s": ""}


def test_chunks(spark):
    df = spark.createDataFrame([("A b c. D e. F g h i. J.",)], "t string").select(sentences("t").alias("s"))
    assert df.select(chunks(6, 1)("s").alias("c")).first().c == ["A b c. D e.", "D e. F g h i.", "F g h i. J."]
    assert df.select(chunks(6, 1, len)("s").alias("c")).first().c == ["A b c.", "D e.", "F g h i.", "J."]
    assert runs([3], 2, 1) == [(0, 1)]
    assert runs([], 2, 1) == []


def test_sessions(spark):
    from datetime import datetime

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    log = [("a", at(10, 0)), ("a", at(10, 29)), ("a", at(10, 58)), ("b", at(10, 0)), ("b", at(10, 30))]
    df = spark.createDataFrame([(s, "q", "m", 4.0, t, k) for k, (s, t) in enumerate(log)], ENTRIES)
    assert sorted((r.session_id, r.entries) for r in cache.sessions(df, "30 minutes").collect()) == [("a", 3), ("b", 1), ("b", 1)]
    assert cache.flush(df, "30 minutes", now="2024-01-01 10:31:00").count() == 1
    assert cache.flush(df, "30 minutes", immediate=True).count() == 3


def test_hooks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "")], "id string, document string")
    got = {r.id: r.dense for r in embed(df, "document").collect()}
    assert got["a"] == got["b"] and len(got["c"]) == 64
    assert {r.q: r.qvec for r in query_embed(spark.createDataFrame([("1", "x y"), ("2", None)], "q string, text string")).collect()} == {"1": got["a"], "2": got["c"]}
    empty = create_collection(spark, str(tmp_path / "c"))
    assert ingest_texts(empty, df).count() == 3 and ingest_texts(ingest_texts(empty, df), df).count() == 3

    def model():
        def f(p):
            if p == "bad":
                raise RuntimeError("no")
            return p.upper()

        return f

    prompts = spark.createDataFrame([("1", "hi"), ("2", "bad")], "query_id string, prompt string")
    assert {r.query_id: (r.answer, r.error) for r in generate(prompts, model, 2).collect()} == {"1": ("HI", None), "2": (None, "RuntimeError: no")}


def test_dense_is_exact_and_independent_of_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([("c", str(k), [float(v) for v in r]) for k, r in enumerate(x)], "collection string, id string, dense array<double>")
    q = df.limit(7).select("collection", F.col("id").alias("query_id"), F.col("dense").alias("qvec"))
    one, two = (sorted(map(tuple, dense.dense_topk(q, df.repartition(n), 5).collect())) for n in (1, 9))
    assert [(a, b, d) for a, b, _, d in one] == [(a, b, d) for a, b, _, d in two] and len(one) == 35
    assert all(r[1] == r[0] for r in one if r[3] == 1)


def test_vectors_that_are_no_numbers_take_no_place(spark):
    rng = random.Random(9)
    good = [(f"g{k}", [rng.gauss(0, 1) for _ in range(4)]) for k in range(12)]
    bad = [(f"b{k}", [float("nan") if k % 2 else float("-inf"), 1.0, 1.0, 1.0]) for k in range(8)]
    q = spark.createDataFrame([("c", "q", [1.0, 0.0, 0.0, 0.0])], "collection string, query_id string, qvec array<double>")
    frame = lambda rows: spark.createDataFrame([("c", *r) for r in rows], "collection string, id string, dense array<double>").coalesce(1)
    got, want = (sorted(map(tuple, dense.dense_topk(q, frame(rows), 5).collect())) for rows in (bad + good, good))
    assert got == want and len(got) == 5


@pytest.mark.parametrize("immediate", [True, False])
def test_flush_gathers_no_entries(spark, immediate):
    from datetime import datetime, timedelta

    rng, zero, gap = random.Random(8), datetime(2024, 1, 1), timedelta(minutes=30)
    rows, at = [], {}
    for k in range(600):
        s = rng.choice(["a", "a", "b", None])
        at[s] = at.get(s, zero) + timedelta(minutes=rng.choice([1, 5, 20, 29, 30, 31, 70]), microseconds=rng.choice([0, 0, -1]))
        rows.append((s, rng.choice(["q1", "q2", None]), f"m{k}", float(rng.randrange(6)) if rng.random() < 0.9 else None, at[s], k))
    df = spark.createDataFrame(rows, "session_id string, question_id string, msg string, rating double, ts timestamp, seq long")
    now, want, runs_ = max(x[4] for x in rows) - timedelta(hours=8), {}, {}
    for r in rows:
        of = runs_.setdefault(r[0], [])
        if not of or r[4] - of[-1][-1][4] >= gap:
            of.append([])
        of[-1].append(r)
    for s, of in runs_.items():
        for run in of:
            if immediate or run[-1][4] + gap <= now:
                want |= {(s, run[0][4], r[1]): (r[2], int(r[3])) for r in sorted(run, key=lambda r: (r[4], -r[5])) if r[3] is not None}
    flushed = cache.flush(df, "30 minutes", now=str(now), immediate=immediate)
    assert {(r.session_id, r.start, r.question_id): (r.msg, r.rating) for r in flushed.collect()} == want
    assert "collect_list" not in flushed._jdf.queryExecution().toString()


def test_cleared_history_starts_anew(spark):
    turns = [("user", "u1"), ("assistant", "b1"), ("user", chat.CLEAR), ("assistant", "Hello."), ("user", "u2"), ("assistant", "b2"), ("user", "u3"), ("user", chat.CLEAR), ("user", chat.CLEAR), ("user", "u4")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "assistant", chat.CLEAR), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.history for r in chat.prompt_history(df, clear=chat.CLEAR).collect()}
    assert got == {(1, 0): chat.NONE, (1, 4): chat.NONE, (1, 6): "Юзер: u2 | Бот: b2", (1, 9): chat.NONE, (2, 1): chat.NONE}
    assert {r.turn for r in chat.pairs(df, clear=chat.CLEAR).filter("conv_id = 1").collect()} == {0, 4, 6, 9}
    assert {(r.conv_id, r.turn) for r in chat.prompt_history(df).collect()} > set(got)
    assert plan_of(chat.prompt_history(df, clear=chat.CLEAR)).count("Exchange") == 1


def test_chunks_of_many_documents(spark):
    """Against the plain walk from run to run; a counter of one's own gives the same as the built-in one."""
    rng = random.Random(6)
    docs = [[" ".join(rng.choices(["a", "bb", "c\td", "é x", "\t", " e ", ""], k=rng.randint(1, 5))) for _ in range(rng.randint(0, 30))] for _ in range(60)] + [None, []]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "id long, ss array<string>").repartition(3)
    for most, overlap in ((1, 0), (7, 1), (12, 3), (1000, 2)):
        want = {k: [" ".join(d[s:e]) for s, e in runs(np.array([len(x.split()) for x in d]), most, overlap)] if d else [] for k, d in enumerate(docs)}
        for counter in ({}, {"count_tokens": lambda x: len(x.split())}):
            assert {r.id: r.c for r in df.select("id", chunks(most, overlap, **counter)("ss").alias("c")).collect()} == want
