"""The functions that users plug in, with deterministic defaults."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.sources import kept
from askmill.sources.shared import cut


def hash_embed(texts: list[str], size: int = 64) -> np.ndarray:
    """Feature hashing of words, of unit length: the built-in embedder for tests. The same words give the same vector."""
    out = np.zeros((len(texts), size), np.float32)
    for k, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % size] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embed(df: DataFrame, text: str, out: str = "dense", model: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hash_embed, batch: int = 64) -> DataFrame:
    """Adds a vector of each text. ``model`` is called once in each task and gives the function that embeds a batch."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model()
        for part in parts:
            rows = []
            for k in range(0, len(part), batch):
                rows += list(f(part.iloc[k : k + batch].tolist()))
            yield pd.Series(rows, index=part.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def attempted(df: DataFrame, text: str, out: str, kind: str, model: Callable[[], Callable[[list[str]], list]], batch: int = 64, why: str = "why") -> tuple[DataFrame, DataFrame]:
    """The rows with ``out``, what ``model`` makes of their text, and apart from them the rows that it fails on, with the error (``why``).

    A batch that fails is tried again row by row, so one bad text costs no other its result. A result of null is no failure. The results are written, so the model is asked once for both tables.
    """

    @F.pandas_udf(f"value {kind}, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = model()

        def each(texts: list[str]) -> list[tuple]:
            try:
                values = list(f(texts))
                if len(values) != len(texts):
                    raise ValueError(f"{len(values)} results of {len(texts)} texts")
                return [(v, None) for v in values]
            except Exception as e:  # noqa: BLE001  a user's function may fail in any way
                return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [x for t in texts for x in each([t])]

        for part in parts:
            texts = part.tolist()
            found = [x for k in range(0, len(texts), batch) for x in each(texts[k : k + batch])]
            yield pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    rows = cut(df.withColumn("__try", run(F.col(text))), "attempted")
    others = [c for c in df.columns if c != out]
    return rows.filter("__try.error is null").select(*others, F.col("__try.value").alias(out)), rows.filter("__try.error is not null").select(*[c for c in df.columns if c != why], F.col("__try.error").alias(why))


def embed_kept(df: DataFrame, text: str, path: str, out: str = "dense", **hook) -> DataFrame:
    """Adds a vector of each text, as ``embed`` does, from the vectors kept below ``path``. Only distinct texts that have none there go to the model; theirs are kept as well.

    ``path``: a folder of one model's vectors, in a place that all executors share.
    """
    spark, schema = df.sparkSession, T.StructType([T.StructField(kept.ASKED, T.BinaryType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    rows = df.withColumn("__asked", kept.checksum(text))
    new = kept.missing(rows.select(F.col("__asked").alias(kept.ASKED), F.coalesce(F.col(text), F.lit("")).alias("text")), kept.read(spark, path, schema))
    kept.append(embed(new, "text", "vector", **hook).select(*schema.names), path)
    known = kept.read(spark, path, schema).withColumnsRenamed({kept.ASKED: "__known", "vector": out})
    return rows.drop(out).join(known, F.col("__asked") == F.col("__known"), "left").drop("__asked", "__known")


def query_embed(queries: DataFrame, text: str = "text", out: str = "qvec", prefix: str = "", **hook) -> DataFrame:
    """Adds a vector of each query, as ``embed`` does for texts; a null text counts as empty. ``prefix``: what a model wants before a question, as some tell questions from texts by it."""
    asked = queries.withColumn("__asked", F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))))
    return embed(asked, "__asked", out, **hook).drop("__asked")


def generate(prompts: DataFrame, model: Callable[[], Callable[[str], str]], slots: int, query_id: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """query_id, answer, error: one call for each prompt on ``slots`` partitions; a call that fails gives an error row, not a failed job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for part in parts:
            rows = []
            for q, p in zip(part[query_id], part[prompt], strict=True):
                try:
                    rows.append((q, f(p), None))
                except Exception as e:  # noqa: BLE001  a user's function may fail in any way
                    rows.append((q, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "error"])

    kind = prompts.schema[query_id].dataType.simpleString()
    return prompts.select(query_id, prompt).repartition(slots).mapInPandas(run, f"query_id {kind}, answer string, error string")


def generate_kept(prompts: DataFrame, model: Callable[[], Callable[[str], str]], slots: int, path: str, query_id: str = "query_id", prompt: str = "prompt", each: int = 16) -> DataFrame:
    """query_id, answer, error as ``generate`` gives them, each distinct prompt asked once: answers are kept below ``path``, and a run that starts anew asks only what is open.

    ``slots`` tasks ask at a time, ``each`` prompts a task, round by round. A task's answers are kept as it ends, so a run that dies repeats
    the prompts of unfinished tasks alone; with ``each`` 1, none. Errors aren't kept: the next run tries those prompts again.
    """
    spark, schema = prompts.sparkSession, T.StructType([T.StructField(kept.ASKED, T.BinaryType()), T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    rows = prompts.select(F.col(query_id).alias("query_id"), F.coalesce(prompt, F.lit("")).alias("text")).withColumn("__asked", kept.checksum("text"))
    # A prompt that once failed and was answered later is answered.
    known = lambda: kept.read(spark, path, schema, F.col("error").isNotNull())
    new = cut(kept.missing(rows.select(F.col("__asked").alias(kept.ASKED), "text"), known().filter("error is null")), "prompts")
    rounds = -(-new.count() // (slots * each))
    for k in range(rounds):
        due = new.filter(F.pmod(F.xxhash64(kept.ASKED), F.lit(rounds)) == k)
        kept.append(generate(due, model, slots, kept.ASKED, "text").withColumnRenamed("query_id", kept.ASKED), path)
    return rows.join(known().withColumnRenamed(kept.ASKED, "__known"), F.col("__asked") == F.col("__known"), "left").select("query_id", "answer", "error")
