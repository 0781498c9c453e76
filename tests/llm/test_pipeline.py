"""The pipeline's stages on small tables, each against a brute-force version of its decisions over what it was given."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from askmill.llm import quality
from askmill.llm.common import cut
from askmill.llm.language import fit, identify
from tests.llm.test_duplicates import brute_components, shingles
from tests.llm.test_text_operators import brute_base, brute_targets
from tests.oracle import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "12 34 !!", None, None, 8)], docs.schema)
    given = docs.unionByName(odd)
    tables, rows = [given], [{r.doc_id: r for r in given.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(cut(stage(spark, tables[-1], SMALL), name))
        assert tables[-1].columns == docs.columns
        rows.append({r.doc_id: r for r in tables[-1].collect()})
    start, language, quality_kept, dedup, _ = rows
    assert not {9001, 9002, 9003} & set(language)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r.quality == 1 and not brute_base(start[i].text or "")[5]}
    assert len(clean & set(quality_kept)) >= 0.99 * len(clean)
    found = {r.doc_id: r.lang_pred for r in identify(given, fit(given)).collect()}
    assert all(r.lang == found[i] for i, r in language.items())  # later stages judge by the language that was told
    verdicts = {r.doc_id: r.kept for r in quality.judge(tables[1]).collect()}
    assert set(quality_kept) == {i for i, kept in verdicts.items() if kept}
    sets = {i: shingles(r.text, 5) for i, r in quality_kept.items()}
    ids, links = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    part = brute_components(sets, links)
    assert set(dedup) == {i for i in ids if part[i] == i}
    sizes, taken = Counter(), Counter()
    for r in dedup.values():
        sizes[r.source] += brute_base(r.text)[0]
    for r in tables[4].collect():
        taken[r.source] += brute_base(r.text)[0]
    largest = Counter()
    for r in dedup.values():
        largest[r.source] = max(largest[r.source], brute_base(r.text)[0])
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in brute_targets(dict(sizes)).items())
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[4], SMALL).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in tables[4].collect())
    assert sum(r.length for r in packed) == want
    assert max(Counter((r.sequence_id, r.offset) for r in packed).values()) == 1


def test_language_needs_certainty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, by = random.Random(3), {}
    for r in docs.orderBy("doc_id").collect():
        if r.text and r.lang:
            by.setdefault(r.lang, []).append(r.text)
    part = lambda lang: (rng.choice(by[lang]) * 300)[:3000]
    mixed = [" ".join(map(part, rng.sample(sorted(by), 2 + k % 2))) for k in range(40)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(3000)) for _ in range(40)]
    rows = [(9_000_000 + k, t, None, "s", len(t)) for k, t in enumerate(mixed + noise)]
    given = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, given, SMALL).select("doc_id").collect()}
    assert sum(9_000_000 <= i < 9_000_040 for i in kept) <= 4 and sum(i >= 9_000_040 for i in kept) <= 4
    clean = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert len(clean & kept) >= 0.995 * len(clean)
    assert corpus_pipeline.least_score(2) > corpus_pipeline.least_score(4) > 0.5


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), name)
    assert docs.count() == 0


def test_extra_columns_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"score": F.lit("mine"), "k": F.lit(1), "kept": F.lit(False)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SMALL))
        assert docs.columns[-3:] == ["score", "k", "kept"]
    assert docs.filter("score = 'mine' and k = 1 and not kept").count() == docs.count() > 0
