"""Near duplicates and vectors against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askmill.llm import minhash, vectors
from askmill.llm.components import components
from tests.oracle import SMALL


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    n = 60
    links = {"chain": [(k, k + 1) for k in range(n)], "star": [(5, k) for k in range(n) if k != 5] * 2, "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], "none": []}[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for p in links for x in p if p[0] != p[1]}
    assert got == brute_components(ids, [p for p in links if p[0] != p[1]])


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def planted():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = [(k, " ".join(base)) for k in range(5)]  # exact copies
    for k in range(40):  # a large group of copies with a few words changed each
        w = list(base)
        for at in rng.sample(range(150), rng.randint(1, 4)):
            w[at] = word()
        rows.append((100 + k, " ".join(w)))
    chain = [word() for _ in range(120)]
    for k in range(12):  # each near the next, the ends far apart
        chain = [*chain[3:], word(), word(), word()]
        rows.append((200 + k, " ".join(chain)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "É é"), (307, "é é"), (308, " ".join(word() for _ in range(30)))]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # buckets of many blocks
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [(i + 1000, t) for i, t in given] + planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "component": F.lit(2), "n": F.lit("x")})
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(i for i, s in sets.items() if s)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    want = brute_components(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, size, percent).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert minhash.near_duplicates(df.limit(0), size, percent).count() == 0


def test_null_keys_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in minhash.keep_one(df.filter("doc_id is not null")).collect()) == [1, 1]


def test_estimates_are_near(spark):
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 0.95):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000).astype(np.uint64)
            both = int(2000 * share)
            rest = (2000 - both) // 2
            a, b = np.unique(x[: both + rest]), np.unique(np.r_[x[:both], x[both + rest :]])
            n = lambda s: np.array([len(s)])
            errors.append(float(minhash.estimate(np.array([(minhash.registers(a) == minhash.registers(b)).sum()]), n(a), n(b))[0]) - both / 2000)
        assert abs(np.mean(errors)) < 0.02


def test_bands_suit_the_threshold(spark):
    assert minhash.missed(80, minhash.band_rows(80)) < 1e-5 and minhash.band_rows(85) == 8
    rng, rows = random.Random(11), []
    for k in range(1000):  # pairs that share 80 % of their shingles or just above
        both, left, right = ([f"{rng.getrandbits(60):x}" for _ in range(n)] for n in (241, 30, 30))
        rows += [(2 * k, " ".join(both + left)), (2 * k + 1, " ".join(both + right))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.near_duplicates(df, 1, 80).filter("not kept").count() == 1000


def unit(x):
    return x / np.linalg.norm(x)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        rows.append((k, unit(rng.normal(size=32)), k % 3))
    center = unit(rng.normal(size=32))
    rows += [(200 + k, unit(center + rng.normal(size=32) * 0.035), 1) for k in range(60)]  # near and around the threshold
    rows += [(300 + k, center, 2 if k % 2 else 1) for k in range(6)] + [(310, center * 7, 1)]
    data = [(i, [float(v) for v in x.astype(np.float32)], y) for i, x, y in rows]
    odd = [(400, None, 1), (401, [0.0] * 32, 1), (402, [None] + [1.0] * 31, 1), (403, [float("nan")] + [1.0] * 31, 1), (404, [float(v) for v in center], None), (405, [float(v) for v in center], None), (406, [1.0, 0.0], 1), (407, [2.0, 0.0], 1), (408, [], 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int").withColumns({"d": F.lit(1), "copies": F.lit(2)})
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(data) + len(odd)
    links = []
    for a in range(len(data)):
        for b in range(a + 1, len(data)):
            x, y = (np.array(data[k][1]) for k in (a, b))
            if data[a][2] == data[b][2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((data[a][0], data[b][0]))
    links.append((406, 407))
    n = {i: 0 for i in got}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found, whole = sum(r.n_links for r in got.values()), 2 * len(links)
    assert 0.99 * whole <= found <= whole and all(got[i].n_links <= n[i] for i in n)
    want = brute_components(got, links)
    assert sum(got[i].component_id == want[i] for i in got) >= len(got) - 1
    assert all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 403, 404, 405, 408))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_labels_and_double_vectors(spark, monkeypatch):
    rows = [(1, [1e39, 1e39], "a"), (2, [1e39, 1e39], "a"), (3, [1.0, 1.0 + 1e-12], "a"), (4, [1.0, 1.0], "b"), (5, [1e-200, 1e-200], "a"), (6, [-1.0, -1.0], "a"), (None, [1.0, 1.0], "a"), (6, [-1.0, -1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"of": F.lit(1), "l": F.lit("x"), "s": F.lit(0), "bits": F.lit(9)})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got[1:] == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 3, 1, False), (6, 1, 6, True), (6, 1, 6, True)]


def test_wider_bands_find_as_much(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 1)  # eleven bits for two thousand vectors
    rng, pairs = np.random.default_rng(8), []
    for k in range(1000):
        x, y = unit(rng.normal(size=24)), unit(rng.normal(size=24))
        y = unit(y - (x @ y) * x)
        pairs += [(2 * k, x.tolist(), 1), (2 * k + 1, (0.9301 * x + (1 - 0.9301**2) ** 0.5 * y).tolist(), 1)]
    df = spark.createDataFrame(pairs, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df).filter("n_links > 0").count()
    assert got >= 1996 and vectors.bands(11, 0.93) > vectors.bands(8, 0.93) == 16


def coded(spark, x, bits):
    reps = spark.createDataFrame([(k, v.tolist(), 0, x.shape[1], bits) for k, v in enumerate(x)], "r long, emb array<double>, kind long, d int, bits int")
    return vectors._coded(reps, 0.93)


def test_hot_bucket_of_one_label(spark):
    # A label of unlike vectors: what is compared grows with its vectors, not with their square.
    rng = np.random.default_rng(9)
    made = [vectors._units(coded(spark, rng.normal(size=(n, 16)), max(8, int(np.ceil(np.log2(n / 4)))))).count() / n for n in (2_000, 8_000)]
    assert made[1] < 1.6 * made[0]


def test_vectors_come_to_open_pairs_alone(spark):
    # 50,000 unlike vectors of a label, some of them twice: narrow rows choose, and hardly any vector is sent.
    rng = np.random.default_rng(10)
    n, d = 50_000, 64
    x = rng.normal(size=(n, d))
    x[-100:] = x[:100] + 0.01 * rng.normal(size=(100, d))
    units = vectors._units(coded(spark, x, 8))
    assert "vec" not in units.columns and "emb" not in units.columns
    sent = units.select(F.count("*").alias("rows"), F.sum(F.length("code") + 8 * (len(units.columns) - 1)).alias("bytes")).first()
    assert sent.bytes < 4 * 8 * d * n and sent.rows == 16 * n
    open_ = vectors._involved(units, 0.93)
    fetched = open_.count()
    assert open_.filter(F.col("r") >= n - 100).select("r").distinct().count() == 100 and fetched < n / 10


def test_bounds_hold():
    rng = np.random.default_rng(6)
    d, n, t = 64, 600, 0.93
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, n, d)))
    z -= (x * z).sum(1, keepdims=True) * x
    q = t * x + np.sqrt(1 - t * t) * z / np.linalg.norm(z, axis=1, keepdims=True)  # each at the threshold with its like, unlike the others
    turn = vectors.turns(d)

    def side(v):
        packed, factors = vectors.encode(v, turn)
        return vectors.decoded([np.array([d, 8], "<i4").tobytes() + f.tobytes() + p.tobytes() for f, p in zip(factors, packed, strict=True)], turn)

    left, right = side(x), side(q)
    guess, error = vectors.estimates(left, right, d, t)
    off = np.diag(guess) - t
    assert abs(off.mean()) < 0.02 and (np.abs(off) <= vectors.TRUST * np.diag(error)).all() and np.sqrt((off**2).mean()) <= np.diag(error).mean()
    assert abs((guess - x @ q.T).mean()) < 0.002
    assert np.diag(vectors.possible(left, right, d, t, 0)).all() and vectors.possible(left, right, d, t, 0).mean() < 0.05
