"""The quality classifier and the phrase miner against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askmill.llm import classifier, collocations
from tests.oracle import SMALL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return classifier.fit(docs, labels)


def test_quality_is_told_on_held_out_documents(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = classifier.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and len(rows) > 100
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    assert np.mean([a < b for a in bad for b in good]) > 0.99


def plain_score(model, text):
    ws = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 1 / (1 + np.exp(-model.bias))
    h = [int(x) for x in pd.util.hash_array(np.asarray(ws, object), categorize=False)]
    mix, top, full = 0x9E3779B97F4A7C15, 64 - classifier.BITS, (1 << 64) - 1
    found = Counter(x >> top for x in h)
    found.update((((a * mix + (b ^ b >> 31)) & full) * mix & full) >> top for a, b in zip(h, h[1:], strict=False))
    for back in (1, 2):
        found.update(back for a, b in zip(ws, ws[back:], strict=False) if a == b)
    x = sum(model.weights[k] * np.sqrt(n / sum(found.values())) for k, n in found.items()) + model.bias
    return 1 / (1 + np.exp(-x))


def test_scores_are_dot_products(spark, model):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("k"))
    odd = spark.createDataFrame([(None, None), (5, ""), (5, ""), (7, " \n"), (8, "x"), (9, "A1b2 b2 b2,b2"), (10, "word salad " * 60_000)], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as k")
    every = docs.unionByName(odd)
    got = sorted((r.doc_id or -1, r.held_out, round(r.score, 6), r.predicted) for r in classifier.score(every, model).collect())
    want = sorted((r.doc_id or -1, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1, round(float(p), 6), int(p >= 0.5)) for r in every.collect() for p in [plain_score(model, r.text)])
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-5)


def test_odd_labels(spark):
    docs = spark.createDataFrame([(k, f"word{k} good", k) for k in range(30)] + [(None, "x", 1), (3, None, 1)], "doc_id long, text string, y int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (3, 7)], "doc_id long, quality int")
    assert classifier.fit(docs, none) is None  # none of these says anything
    assert {(r.score, r.predicted) for r in classifier.score(docs, None).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(k, 1, "z") for k in range(30)] * 2, "doc_id long, quality int, k string")
    assert min(r.score for r in classifier.score(docs, classifier.fit(docs, one)).collect()) > 0.5
    assert classifier.score(docs.limit(0), None).count() == 0


def test_the_sample_is_bounded_and_weighed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda texts, labels, weights: seen.append((texts, labels, weights)))
    docs = spark.createDataFrame([(k, f"t{k} " * 5000) for k in range(3000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(3000)], "doc_id long, quality int")
    classifier.fit(docs, labels, per_label=50)
    classifier.fit(docs, labels, per_label=50)
    (texts, ys, weights), again = seen
    assert again == (texts, ys, weights) and Counter(ys) == {0: 50, 1: 50} and max(map(len, texts)) == classifier.WINDOW
    assert all(zlib.crc32(re.search(r"t(\d+) ", t)[1].encode()) % 3 != 1 for t in texts)
    assert sum(w for w, y in zip(weights, ys, strict=True) if y) / sum(weights) == pytest.approx(0.8, abs=0.03)


# --- phrases ---


def plain_phrases(rows, least=30, most=2000):
    out, f, n = [], {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(ws[k : k + m]) for k in range(len(ws) - m + 1))
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered, ranked = {}, []
        for p, a in candidates.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    covered[p[i : i + s]] = max(a, covered.get(p[i : i + s], 0))
        for p, a in candidates.items():
            if 100 * covered.get(p, 0) < 80 * a:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(ranked)[:most])]
    return sorted(out)


def mined(df, **more):
    found = collocations.phrases(df, **more)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def invented(seed, n=150):
    rng, words = random.Random(seed), ["new", "New", "york", "city", "the", "of", "É", "é", "a-b", "x\xa0y", "1", "日本", "\x00", "'s"]
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " ; ", "!?"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([0, 1, 30, 90])))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("en", ".,;"), ("fr", " \n ")] + [("en", "one two three four five " * 20)] * 3


@pytest.mark.parametrize("bits", [14, 20])
@pytest.mark.parametrize("size", [200, 8 << 20])
def test_phrases_against_brute_force(spark, bits, size, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", size)
    rows = invented(bits + size % 7)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'x' as phrase", "2 as place").repartition(3)
    assert mined(df, bits=bits) == plain_phrases(rows)
    assert mined(df, bits=bits, least=7, most=11) == plain_phrases(rows, 7, 11)


def test_given_phrases(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text")
    got = mined(df)
    assert got == plain_phrases([tuple(r) for r in df.collect()]) and got


def test_phrases_of_nothing_and_of_one_long_text(spark):
    assert mined(spark.createDataFrame([], "lang string, text string")) == []
    rows = [("en", "tick tock " * 100_000 + "boom")]
    assert mined(spark.createDataFrame(rows, "lang string, text string")) == plain_phrases(rows)


def test_slices_keep_texts_apart():
    texts = pa.array(["", "a b", "b.c", " ", "c"])
    s = collocations._Slice(texts, np.zeros(5, np.int64), np.zeros(1, np.uint64))
    assert [s.words[k].as_py() for k in s.number] == ["a", "b", "b", "c", "c"] and s.whole(2).tolist() == [True, False, False, False]
