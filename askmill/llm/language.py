"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from askmill.llm.common import cut

#: Bytes of a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: The training sample's bound: windows for each language.
PER_LANGUAGE = 600
UNKNOWN = "und"
#: Windows that are convolved at once, so that the intermediate arrays stay in the cache.
CHUNK = 64
#: ASCII capitals count as small letters.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


@dataclass
class Network:
    """For each width a table per place in the filter (byte x filter): a convolution over one-hot bytes is a sum of look-ups."""

    languages: list[str]
    tables: list[np.ndarray]  # (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows_of(texts: list[bytes]) -> np.ndarray:
    """One window of each text, cut or filled with zeros."""
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for k, t in enumerate(texts):
        x[k, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    return _SMALL[x]


def train(texts: list[bytes], labels: list[str], steps: int = 240, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Fits the network by Adam on cross entropy. Windows are cropped at random, so that short texts are learned too. None without labels."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    n_out, n_feat = len(languages), FILTERS * len(WIDTHS)
    shapes = [(w, 256, FILTERS) for w in WIDTHS]
    params = [rng.normal(0, 0.1, s).astype(np.float32) for s in shapes] + [np.zeros(n_feat, np.float32), rng.normal(0, 0.1, (n_feat, n_out)).astype(np.float32), np.zeros(n_out, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(y == k) for k in range(n_out)]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_label[k]) for k in rng.integers(0, n_out, batch)])
        crops = []
        for k in pick:
            t = texts[k]
            size = int(rng.integers(24, WINDOW + 1))
            at = int(rng.integers(0, max(1, len(t) - size + 1)))
            crops.append(t[at : at + size])
        x = windows_of(crops)
        pooled, places = [], []
        for w, table in zip(WIDTHS, params[: len(WIDTHS)], strict=True):
            n = WINDOW - w + 1
            act = sum(table[j][x[:, j : j + n]] for j in range(w))
            at = act.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0, :])
        z = np.concatenate(pooled, 1) + params[-3]
        h = np.maximum(z, 0)
        logits = h @ params[-2] + params[-1]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p
        d[np.arange(batch), y[pick]] -= 1
        d /= batch
        back = (d @ params[-2].T) * (z > 0)
        grads = []
        for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
            g = np.zeros(shapes[i], np.float32)
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[np.arange(batch)[:, None], at + j], np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        grads += [back.sum(0), h.T @ d, d.sum(0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(languages, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


class Predictor:
    """Probabilities of whole texts. Tables of byte pairs are made once, so that a filter costs one or two look-ups."""

    def __init__(self, net: Network):
        self.net = net
        two, three, four = net.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.head = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1)
        self.third, self.tail = three[2], pair(four[2], four[3])

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) -> (windows, features): each filter's largest value in a window."""
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for k in range(0, len(x), CHUNK):
            b = x[k : k + CHUNK]
            pairs = b[:, :-1].astype(np.uint16) << 8 | b[:, 1:]
            act = np.take(self.head, pairs, axis=0)
            act[:, :-1, FILTERS : 2 * FILTERS] += np.take(self.third, b[:, 2:], axis=0)
            act[:, :-2, 2 * FILTERS :] += np.take(self.tail, pairs[:, 2:], axis=0)
            o = out[k : k + CHUNK]
            o[:, :FILTERS] = act[:, :, :FILTERS].max(1)
            o[:, FILTERS : 2 * FILTERS] = act[:, :-1, FILTERS : 2 * FILTERS].max(1)
            o[:, 2 * FILTERS :] = act[:, :-2, 2 * FILTERS :].max(1)
        return out

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """A text's probabilities: the mean of its windows', each weighted by its bytes. All windows count, to the text's end."""
        sizes = np.array([len(t) for t in texts], np.int64)
        n = np.maximum(1, -(-sizes // WINDOW))
        flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
        starts = (np.cumsum(n) - n) * WINDOW
        for t, at in zip(texts, starts, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        h = np.maximum(self.pooled(_SMALL[flat].reshape(-1, WINDOW)) + self.net.bias, 0)
        logits = h @ self.net.dense + self.net.dense_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = np.full(len(p), float(WINDOW))
        weight[np.cumsum(n) - 1] = np.maximum(1, sizes - (n - 1) * WINDOW)
        rows = np.add.reduceat(p * weight[:, None], np.cumsum(n) - n, axis=0)
        return rows / rows.sum(1, keepdims=True)


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from training: by a checksum of its key; a null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """Trains on at most ``per_language`` windows of each language, from labelled rows that aren't held out.

    The sample is the first rows of a language by a hash of their key. Languages are counted first, and rows whose hash
    lies far beyond the share that is needed go where they are read, so a common language is no hot spot. A
    window starts at a place in its text that a hash chooses.
    """
    order = F.md5(F.concat(F.lit("sample"), F.col(key).cast("string")))
    rows = docs.filter(~held_out(key) & F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64(F.col(key).cast("string")), F.greatest(F.lit(1), F.length(text) - WINDOW + 1))
    rows = rows.select(F.col(key).cast("string").alias("k"), F.col(label).cast("string").alias("label"), order.alias("o"), F.substring(F.col(text), (start + 1).cast("int"), F.lit(WINDOW)).alias("w"))
    counts = cut(rows.groupBy("label").agg(F.count("*").alias("of")), "languages").withColumnRenamed("label", "l")
    few = counts.limit(10_001).count() <= 10_000
    share = F.pmod(F.xxhash64(F.lit("share"), "k"), F.lit(1 << 30)) / (1 << 30)
    rows = rows.join(F.broadcast(counts) if few else counts, F.col("label") == F.col("l")).filter((F.col("of") <= 2 * per_language) | (share < 2 * per_language / F.col("of")))
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(share, "o", "w"))).filter(F.col("n") <= per_language)
    found = sorted((r.label, r.n, r.w) for r in kept.select("label", "n", "w").collect())
    return train([w.encode() for _, _, w in found], [x for x, _, _ in found])


def identify(docs: DataFrame, net: Network | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability over the whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned.
    Columns of these two names are replaced. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = Predictor(sent.value) if sent.value else None
        for texts in batches:
            found: list[dict] = []
            for k in range(0, len(texts), CHUNK):
                part = [(x or "").encode() for x in texts.slice(k, CHUNK).to_pylist()]
                if predict is None:
                    found += [{"lang": UNKNOWN, "score": 0.0}] * len(part)
                    continue
                p = predict(part)
                best = p.argmax(1)
                found += [{"lang": sent.value.languages[b], "score": float(min(1.0, max(0.0, p[i, b])))} for i, b in enumerate(best)]
            yield pa.array(found, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    guess = arrow_udf(run, "lang string, score double")
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.withColumn("__guess", guess(F.col(text)))
    rows = rows.withColumns({lang: F.when(has_letter, F.col("__guess.lang")).otherwise(F.lit(UNKNOWN)), score: F.when(has_letter, F.col("__guess.score")).otherwise(F.lit(0.0))})
    return rows.drop("__guess")

