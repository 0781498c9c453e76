"""Each registered query over its whole table, and the methods that SQL can't express against plain versions of them."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from askmill.llm import language, minhash, packing, quality, queries, shards, template
from tests.llm.test_learned import plain_phrases
from tests.llm.test_trie import brute_force as trie_by_hand
from tests.oracle import SMALL, connect, rows

COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5": ["conv_id", "turn", "role", "text", "rendered"],
    "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10": ["vec_id", "n_links", "component_id", "kept"],
    "op12": ["doc_id", "held_out", "score", "predicted"],
}
#: Queries with rows of their own, and not one for each row of a table.
DERIVED = {"op11_prefix_trie", "op13_phrases"}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - DERIVED))
def test_query_covers_its_table(spark, name):
    op = name.split("_")[0]
    table, key = {"op1": ("pages", "page_id"), "op5": ("conversations", "conv_id"), "op10": ("embeddings", "vec_id")}.get(op, ("documents", "doc_id"))
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert set(COLUMNS[op]) <= set(got.columns)
    found = [r[0] for r in got.select(key).collect()]
    want = [r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()]
    assert set(found) == set(want) if op == "op9" else Counter(found) == Counter(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = queries.queries()[name](spark, SMALL).toPandas(), connect().execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_derived_rows(spark):
    """The trie and the phrases as the queries give them, over their whole tables."""
    got = [tuple(r) for r in __spark_entry__.queries()["op11_prefix_trie"](spark, SMALL).collect()]
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(got, key=str) == trie_by_hand([tuple(r) for r in turns])
    got = sorted(tuple(r) for r in __spark_entry__.queries()["op13_phrases"](spark, SMALL).collect())
    assert got == plain_phrases([(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]) and got


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def classes(text):
    kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[\x00-\x7F]"]
    return np.array([v for v in (lambda c: [c.get(k, 0) for k in range(6)])(Counter(next((k for k, p in enumerate(kinds) if re.match(p, x)), 5) for x in text))], float)


def test_quality_verdicts_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90_000, None, "en"), (90_001, "", None), (90_002, "Ünïcode ŸŽ " * 40, None), (None, "the of and to " * 30, "en"), (None, "the of and to " * 30, "en"), (90_003, "word " * 6_000, "xx")], "doc_id long, text string, lang string")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.unionByName(odd).collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    refs = {}
    for lang in {x for _, _, x in rows}:
        own = [t for _, t, x in rows if x == lang]
        total = sum((classes(t) for t in own), np.zeros(6))
        words = Counter(w.lower() for t in own for w in split(t))
        n = sum(words.values())
        top = sorted(((-c, w) for w, c in words.items() if re.search(r"[^\W\d_]", w)))[:30]
        shares = [-c / max(1, n) for c, _ in top]
        rest = [max(0.0, 1 - sum(shares))]
        refs[lang] = total / max(1, total.sum()), [w for _, w in top], shares + rest, js([0.0] * len(top) + [1.0], shares + rest)
    want = Counter()
    for i, t, lang in rows:
        own, (c, w, shares, none) = classes(t), refs[lang]
        found = Counter(x.lower() for x in split(t))
        n = sum(found.values())
        far = js(own / max(1, own.sum()), c) if own.sum() >= 100 else 0.0
        mine = [found[x] / max(1, n) for x in w]
        word = js([*mine, max(0.0, 1 - sum(mine))], shares) if n >= 50 else 0.0
        want[i, round(far, 6), round(word, 6), far <= 0.285 and word <= none * min(0.95, 0.6 + 2.5 / math.sqrt(max(1, n)))] += 1
    got = quality.judge(docs.unionByName(odd).withColumns({"w": F.lit(1), "row": F.lit("x"), "classes": F.lit(0)})).collect()
    near = Counter((r.doc_id, round(r.class_distance, 6), round(r.word_distance, 6), r.kept) for r in got if not r.base_failed)
    assert not near - want and sum(near.values()) == sum(not r.base_failed for r in got)
    assert sum(r.doc_id is None for r in got) == 2 and len(got) == len(rows)
    assert Counter(r.doc_id for r in quality.select_kept(docs).collect()) == Counter(r.doc_id for r in quality.judge(docs).filter("kept").collect())


def test_forward_pass_by_hand():
    rng = np.random.default_rng(5)
    net = language.Network(["a", "b", "c"], [rng.normal(size=(w, 256, language.FILTERS)) for w in language.WIDTHS], rng.normal(size=24), rng.normal(size=(24, 3)), rng.normal(size=3))
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 3, 255, 256, 257, 1000, 20_000)]
    for text, got in zip(texts, language.Predictor(net)(texts), strict=True):
        total, weight = np.zeros(3), 0
        for at in range(0, max(1, len(text)), 256):
            window = text[at : at + 256].lower().ljust(256, b"\0")
            best = [max(sum(net.tables[k][j][window[s + j]][f] for j in range(w)) for s in range(256 - w + 1)) for k, w in enumerate(language.WIDTHS) for f in range(language.FILTERS)]
            z = np.maximum(np.array(best) + net.bias, 0) @ net.dense + net.dense_bias
            p = np.exp(z - z.max())
            n = max(1, len(text[at : at + 256]))
            total, weight = total + n * p / p.sum(), weight + n
            if len(text) > 2000 and at > 512:
                break
        if len(text) <= 2000:
            assert np.allclose(total / weight, got, atol=1e-3)


def test_placement_by_hand():
    rng = np.random.default_rng(3)
    for _ in range(20):
        capacity = int(rng.integers(5, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 80)))
        gaps: list[int] = []
        for s in sorted(lengths.tolist(), reverse=True):
            def cost(at):
                after = [g - s if k == at else g for k, g in enumerate(gaps)] + ([capacity - s] if at == len(gaps) else [])
                return sum(n * n for g, n in Counter(after).items() if g)

            # Of equal costs the smallest gap, a new bin last.
            at = min((k for k in range(len(gaps) + 1) if k == len(gaps) or gaps[k] >= s), key=lambda k: (cost(k), gaps[k] if k < len(gaps) else capacity))
            if at == len(gaps):
                gaps.append(capacity)
            gaps[at] -= s
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        left = Counter(capacity - sum(lengths[bins == b]) for b in set(bins.tolist()))
        assert left == Counter(gaps)
        assert all(o == sum(lengths[k] for k in range(len(lengths)) if bins[k] == b and offsets[k] < o) for b, o in zip(bins, offsets, strict=True))


def test_null_keys_repeated_rows_and_long_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    long = " ".join(f"w{k % 977}x" for k in range(20_000))
    data = [(None, "a b"), (None, "a b"), (3, "c d e"), (3, "c d e"), (4, long), (5, None), (6, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("k", "ids", "counts", "piece", "start", "lang")})
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for _, x in data]
    got = shards.read_shards(spark, shards.write_shards(df, path, 2, shards.new_folder(spark)), with_ids=False).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(data, ids, strict=True)]
    assert [r.start for r in got] == np.r_[0, np.cumsum([len(x) for x in ids])[:-1]].tolist()
    pieces = Counter(r.doc_id for r in packing.pack_documents(df, path, 2048).collect())
    assert pieces[None] == 2 and pieces[3] == 2 and pieces[5] == pieces[6] == 1 and pieces[4] == -(-len(ids[4]) // 2048)
    near = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert near[4].n_shingles == len({tuple(long.split()[k : k + 5]) for k in range(20_000 - 4)}) and near[3].kept and near[5].n_shingles == 0
    found = language.identify(df, language.train([b"aaaa bbbb"] * 9, ["a"] * 9, steps=5)).collect()
    assert len(found) == 7 and {r.lang_pred for r in found if r.doc_id == 4} == {"a"}


def test_repeated_pages(spark):
    page = "<html><body><nav>menu</nav><article><p>one</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://h.example/1", page)] * 3 + [(None, None, page)], "page_id long, url string, html string").withColumn("slot", F.lit(1))
    assert Counter((r.page_id, r.text) for r in template.extract(df).collect()) == {(1, "one"): 3, (None, "one"): 1}
