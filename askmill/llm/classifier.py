"""Quality of texts by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words are runs of letters, of digits, or of signs, in small letters; its features are its words and pairs of neighbours, hashed into
2^BITS places, and two places of their own for a word that is the one before it again, or the one before that. A feature's value is the root of its
count, all scaled to unit length, so that long and short texts weigh the same. A score is a sparse dot product, made for
a slice of texts at once. Whole texts are scored, where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from askmill.llm.common import cut
from askmill.llm.language import held_out
from askmill.llm.words import hashes, numbered, slices

#: Places that features are hashed into.
BITS = 20
#: Documents of a label that are trained on at most, and characters of each: a window that starts where a hash says.
PER_LABEL, WINDOW = 4000, 8192
#: Rates of the updates: step, smoothing, and what draws weights to zero.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.1
EPOCHS = 4
# Where words are cut, besides white space.
_SIGNS, _DIGITS = r"([^\p{L}\p{N}\s]+)", r"(\p{N}+)"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of each text and their values, one text after the other, and how many each has."""
    spaced = pc.replace_substring_regex(pc.replace_substring_regex(pc.ascii_lower(texts), _SIGNS, r" \1 "), _DIGITS, r" \1 ")
    number, sizes, distinct = numbered(pc.ascii_split_whitespace(spaced))
    word, text = hashes(distinct)[number], np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    pair = (word[:-1] * _MIX + (word[1:] ^ (word[1:] >> np.uint64(31)))) * _MIX
    places, of = [word >> np.uint64(64 - BITS), pair >> np.uint64(64 - BITS)], [text, text[:-1]]
    keep = [slice(None), text[:-1] == text[1:]]
    for back in (1, 2):  # a repeat counts whatever the word is
        same = (number[:-back] == number[back:]) & (text[:-back] == text[back:])
        places.append(np.full(len(same), back, np.uint64))
        of.append(text[:-back])
        keep.append(same)
    key, count = np.unique(np.concatenate([t[k] << np.uint64(BITS) | p[k] for t, p, k in zip(of, places, keep, strict=True)]), return_counts=True)
    n = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(sizes))
    total = np.r_[0, np.cumsum(count)]
    ends = np.cumsum(n)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.sqrt(count / np.repeat(total[ends] - total[ends - n], n)), n


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text; of one without words, what the labels alone say."""
        flat, values, sizes = features(texts)
        total = np.r_[0.0, np.cumsum(self.weights[flat] * values)]
        ends = np.cumsum(sizes)
        x = total[ends] - total[ends - sizes] + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[str], labels: list[int], weights: list[float], epochs: int = EPOCHS) -> Model:
    """Follow the regularised leader, text by text, ``epochs`` times over them in an order of their own each time. ``weights``: how much each text counts."""
    found = [features(part) for part in slices(pa.array(texts, pa.string()))]
    flat, values, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
    ends = np.cumsum(sizes)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(texts)):
            own = slice(ends[k] - sizes[k], ends[k])
            at, value = flat[own], values[own]
            w = weight(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35)))
            slope = (p - labels[k]) * weights[k]
            g = slope * value
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            bias_n += slope * slope
            bias -= ALPHA * slope / (BETA + np.sqrt(bias_n))
    return Model(weight(z, n).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Model | None:
    """Trains on at most ``per_label`` documents of each label, 0 or 1, that aren't held out; texts count so that the labels weigh as they do among all.

    Labels of one document must agree. The sample is the first of a label by a hash of their key, chosen among the labels alone, so that its keys (bounded)
    go to the documents, which are read once. Without labels there is nothing to learn.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"), F.max(label).alias("z")).filter("y = z")
    rows = cut(rows.select("k", "y", F.xxhash64(F.lit("sample"), F.col("k").cast("string")).alias("o")), "labels")
    of = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, 2 * per_label / n))) for y, n in of.items()], F.lit(1.0))
    near = rows.filter(F.pmod("o", F.lit(1 << 30)) / (1 << 30) <= share)  # of a common label only so many go to where the first are chosen
    few = near.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("o", F.lit(1 << 30)), "o", "k"))).filter(F.col("n") <= per_label).select("k", "y")
    start = F.pmod(F.xxhash64(F.col(key).cast("string")), F.greatest(F.lit(1), F.length(text) - WINDOW + 1))
    window = F.coalesce(F.substring(F.col(text), (start + 1).cast("int"), F.lit(WINDOW)), F.lit(""))
    texts = docs.select(F.col(key).alias("k"), window.alias("t"))
    found = texts.join(F.broadcast(few), "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    found = sorted(found, key=lambda r: r.k)
    if not found:
        return None
    taken = {y: sum(r.y == y for r in found) for y in of}
    weigh = {y: of[y] * len(found) / (sum(of.values()) * taken[y]) for y in of if taken[y]}
    return train([r.t for r in found], [r.y for r in found], [weigh[r.y] for r in found])


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row: the probability of label 1, of its whole text alone. Null and empty texts have a score too: 0.5 if nothing was learned, as all then have. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.full(len(part), 0.5) if sent.value is None else sent.value(part) for part in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    probability = arrow_udf(run, "double")
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), probability(F.col(text)).alias("score"))
    return rows.select(key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
