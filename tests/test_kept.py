"""Results kept between runs, failures kept apart, and counts taken in the pass that writes."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from askmill.functions.hooks import attempted, embed, embed_kept, generate_kept, hash_embed
from askmill.functions.text import chunk_documents
from askmill.operators import ingest, snapshots
from askmill.sources.shared import cut


def lines(path):
    return sorted(x for f in glob.glob(f"{path}/*") for x in open(f).read().splitlines())


def counting_model(path):
    """An embedder that notes each text it is asked for."""

    def model():
        def f(texts):
            with open(f"{path}/{os.getpid()}", "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return hash_embed(texts)

        return f

    return model


def test_each_text_is_embedded_once(spark, tmp_path):
    asked, at = str(tmp_path / "asked"), str(tmp_path / "vectors")
    os.mkdir(asked)
    one = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")], "id long, t string")
    two = spark.createDataFrame([(6, "c"), (7, "d"), (8, "a b")], "id long, t string").repartition(3)
    for df in (one, two, two):
        got = {r.id: r.dense for r in embed_kept(df, "t", at, model=counting_model(asked)).collect()}
        assert got == {r.id: r.dense for r in embed(df.withColumn("t", F.coalesce("t", F.lit(""))), "t").collect()} and len(got) == df.count()
    assert lines(asked) == ["", "a b", "c", "d"]


def test_a_run_that_died_goes_on(spark, tmp_path):
    asked, at = str(tmp_path / "asked"), str(tmp_path / "answers")
    os.mkdir(asked)
    prompts = spark.createDataFrame([(f"q{k}", f"p{k % 8}") for k in range(10)] + [("bad", "bad")], "query_id string, prompt string")

    def model(deadly):
        def make():
            def f(prompt):
                if prompt == "p5" and deadly:
                    os._exit(1)
                with open(f"{asked}/{os.getpid()}", "a") as out:
                    out.write(f"{prompt}\n")
                if prompt == "bad":
                    raise ValueError("no answer")
                return prompt.upper()

            return f

        return make

    with pytest.raises(Exception):  # noqa: B017  Spark's own, when a worker dies
        generate_kept(prompts, model(True), 1, at, each=1)
    before = lines(asked)
    got = {r.query_id: (r.answer, r.error) for r in generate_kept(prompts, model(False), 1, at, each=1).collect()}
    assert got == {f"q{k}": (f"P{k % 8}", None) for k in range(10)} | {"bad": (None, "ValueError: no answer")}
    told = [x for x in lines(asked) if x != "bad"]
    assert told == sorted({f"p{k}" for k in range(8)}) and 0 < len(before) < 9
    generate_kept(prompts, model(False), 3, at).collect()
    assert [x for x in lines(asked) if x != "bad"] == told  # only what failed is asked again


def test_failures_stand_apart(spark):
    def model():
        def f(texts):
            if any("bad" in (t or "") for t in texts):
                raise ValueError("bad text")
            return [len(t or "") for t in texts]

        return f

    rows = spark.createDataFrame([(k, "bad" if k % 7 == 3 else None if k == 5 else "x" * k, "e") for k in range(40)], "id long, t string, error string")
    good, bad = attempted(rows, "t", "size", "int", model, batch=8)
    assert {r.id: r.size for r in good.collect()} == {k: 0 if k == 5 else k for k in range(40) if k % 7 != 3}
    assert {(r.id, r.why) for r in bad.select("id", "why").collect()} == {(k, "ValueError: bad text") for k in range(40) if k % 7 == 3}


FILES, INDEX = "collection string, path string, fingerprint string", "collection string, file_path string, fingerprint string, chunk_index int, id string, document string"


def test_sync_by_content(spark):
    files = spark.createDataFrame([("c", "same", "1"), ("c", "changed", "2"), ("c", "new", "3"), ("d", "same", "1"), ("c", "half", "5"), (None, "same", "1")], FILES)
    index = spark.createDataFrame([("c", p, f, k, f"{p}{k}", "old") for p, f, n in [("same", "1", 2), ("changed", "9", 4), ("gone", "7", 3), ("half", "5", 1)] for k in range(n)] + [("c", "half", "4", 1, "half1", "old"), ("c", "same", "1", 2, "same2", "old")], INDEX)
    status = ingest.sync_content(files, index)
    assert sorted(map(str, map(tuple, status.collect()))) == sorted(map(str, [("c", "same", "same", 3), ("c", "changed", "changed", 4), ("c", "new", "new", 0), ("d", "same", "new", 0), ("c", "half", "changed", 2), ("c", "gone", "gone", 3), (None, "same", "new", 0)]))
    due = spark.createDataFrame([("c", "changed", "2", 0, "changed0", "now"), ("c", "new", "3", 0, "new0", "now"), ("d", "same", "1", 0, "dsame0", "now"), ("c", "half", "5", 0, "half0", "now")], INDEX)
    after = ingest.resync(index, status, due)
    got = sorted((r.id, r.document) for r in after.collect())
    assert got == [("changed0", "now"), ("dsame0", "now"), ("half0", "now"), ("new0", "now"), ("same0", "old"), ("same1", "old"), ("same2", "old")]
    # Twice is once; what is gone from the files is gone from the index.
    known = files.filter("collection is not null")
    again = ingest.sync_content(known, after)
    assert {r.status for r in again.collect()} == {"same"}
    assert sorted((r.id, r.document) for r in ingest.resync(after, again, due).collect()) == got


def test_a_failed_file_stays_due(spark):
    texts = {"a": "One. Two.", "b": "Fail here.", "c": "Three."}
    fails = lambda: lambda ts: [1 / 0 if "Fail" in t else t.upper() for t in ts]
    files = spark.createDataFrame([("c", p, t) for p, t in texts.items()], "collection string, path string, text string").withColumn("fingerprint", ingest.fingerprint("text"))
    index = spark.createDataFrame([("c", "b", "old", 0, "b0", "OLD.")], INDEX)
    for left in (["b"], ["b"], []):
        status = ingest.sync_content(files, index).filter("status <> 'same'")
        due = files.join(status, ["collection", "path"]).select("collection", F.col("path").alias("file_path"), "fingerprint", "text")
        read, failed = attempted(due, "text", "read", "string", fails if left else lambda: lambda ts: [t.upper() for t in ts])
        chunks = chunk_documents(read.drop("text").withColumnRenamed("read", "text"))
        index = ingest.resync(index, ingest.sync_content(files, index), chunks, failed)
        index = cut(index)
        assert sorted(r.path for r in ingest.sync_content(files, index).filter("status in ('new', 'changed')").collect()) == left
        assert {r.file_path: r.document for r in index.collect()} == {"a": "ONE. TWO.", "b": "OLD." if left else "FAIL HERE.", "c": "THREE."}


def test_counts_come_with_the_write(spark, tmp_path):
    docs = spark.createDataFrame([("a", "p", "One two. Three four."), ("a", "q", None), ("b", "r", "Five."), ("z", "s", "Six.")], "collection string, file_path string, text string")
    chunks, seen = ingest.observed_chunks(chunk_documents(docs, 2, 0), ["a", "b", "none"])
    chunks.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"chunks": 4, "bytes": len("One two.Three four.Five.Six."), "other": 1, "chunks of a": 2, "chunks of b": 1, "chunks of none": 0}
    report = {r.collection: r.chunks for r in ingest.ingest_report(docs, spark.read.parquet(str(tmp_path / "out")), docs.limit(0)).collect()}
    assert all(seen.get[f"chunks of {c}"] == report[c] for c in "ab")
    assert chunks._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    with pytest.raises(ValueError):
        ingest.observed_chunks(chunks, list(map(str, range(1001))))


def test_many_snapshots_are_one_scan(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1)], "id string, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (file,) = glob.glob(str(tmp_path / "one" / "*.parquet"))
    for k in range(1500):
        at = tmp_path / "snaps" / f"s{k}" / f"collection=c{k}"
        at.mkdir(parents=True)
        shutil.copy(file, at / "part-0.parquet")
    chosen = spark.createDataFrame([(f"c{k}", f"s{k}", "ok") for k in range(1500)] + [("c1", "s0", "missing")], "collection string, name string, status string")
    found = snapshots.recover(spark, chosen, str(tmp_path / "snaps"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.collection for r in found.collect()) == sorted(f"c{k}" for k in range(1500))


def test_odd_names_are_recovered(spark, tmp_path):
    rows = spark.createDataFrame([(c, c or "null") for c in ("a b", "a+b", "a%20b", "ä/ö", "=#?", None)], "collection string, id string")
    snapshots.write_snapshot(rows, str(tmp_path), "n1")
    snapshots.write_snapshot(rows.withColumn("more", F.lit(1)), str(tmp_path), "n 2")
    chosen = rows.select("collection", F.when(F.col("collection") == "a b", "n 2").otherwise("n1").alias("name"), F.lit("ok").alias("status"))
    got = {(r.collection, r.id, r.more) for r in snapshots.recover(spark, chosen, str(tmp_path)).collect()}
    assert got == {(c, c or "null", 1 if c == "a b" else None) for c in ("a b", "a+b", "a%20b", "ä/ö", "=#?", None)}
